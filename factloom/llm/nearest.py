"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a sample of at most about ``SAMPLE`` vectors and cut where a leaf is expected to
hold ``LEAF_ROWS`` rows; all rows are then assigned to its leaves. Consecutive leaves form shards of a
bounded size, and a leaf with more rows than a shard is dealt over several, so copies or one dense
region never meet in one task.

A query walks the tree best bin first: nodes wait in a priority queue by their inner product with the
query, the best is taken, and a leaf taken is a leaf visited. How many leaves are visited is
calibrated: for ``CALIBRATION`` queries the true neighbours among all rows are found by brute force in
blocks, and visits are widened until their mean recall reaches ``TARGET``.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids; a shorter vector is filled with zeros; several rows of one id count as one, with the
smallest vector; equal scores go to the smaller id; fewer candidates than k give all that are found;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.vectors import matrix, valid_vectors, width, with_roles
from factloom.session import materialize

SAMPLE = 16_384
BRANCHES = 8
LEAF_ROWS = 128
SHARD_ROWS = 4096
CALIBRATION = 192
TARGET = 0.96
ITERATIONS = 8


class Tree:
    """Centres of all nodes in the order they were made; children of a node stand together."""

    def __init__(self, sample: np.ndarray, leaf_sample: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres = [sample.mean(axis=0)]
        self.children: list[range] = [range(0)]
        self.leaf_of: dict[int, int] = {}
        waiting = [(0, np.arange(len(sample)))]
        while waiting:
            node, own = waiting.pop()
            parts = self._split(sample, own, rng) if len(own) > max(leaf_sample, BRANCHES) else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            first = len(self.centres)
            for part in parts:
                self.centres.append(sample[part].mean(axis=0))
                self.children.append(range(0))
            self.children[node] = range(first, first + len(parts))
            waiting.extend((first + i, part) for i, part in reversed(list(enumerate(parts))))
        self.centres = np.array(self.centres)
        self.leaves = len(self.leaf_of)

    @staticmethod
    def _split(sample: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        points = sample[own]
        centres = points[rng.choice(len(points), BRANCHES, replace=False)]
        near = None
        for _ in range(ITERATIONS):
            now = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            if near is not None and (now == near).all():
                break
            near = now
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = points[near == c].mean(axis=0)
        return [own[near == c] for c in range(len(centres)) if (near == c).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point: always to the nearest child."""
        node = np.zeros(len(points), dtype=np.int64)
        moving = {0: np.arange(len(points))} if len(points) else {}
        while moving:
            after: dict[int, np.ndarray] = {}
            for at, own in moving.items():
                kids = self.children[at]
                if not len(kids):
                    node[own] = self.leaf_of[at]
                    continue
                centres = self.centres[kids.start : kids.stop]
                near = ((centres**2).sum(axis=1) - 2 * points[own] @ centres.T).argmin(axis=1)
                for c in np.unique(near):
                    after[kids[int(c)]] = own[near == c]
            moving = after
        return node

    def visits(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and further ones until they hold ``least`` candidates."""
        worth = (self.centres @ query).tolist()
        queue, out, found = [(-worth[0], 0)], [], 0
        while queue and (len(out) < most or found < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                out.append(self.leaf_of[node])
                found += int(held[out[-1]]) if held is not None else 0
            for kid in kids:
                heapq.heappush(queue, (-worth[kid], kid))
        return out


def best(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows but the query's own: preselected by a matrix product, scored in one fixed order of summation."""
    scores = rows @ query
    if len(scores) > k + 1:
        # Anything within rounding of the k-th place stays for the exact comparison.
        edge = np.partition(scores, -k - 1)[-k - 1]
        near = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))
    else:
        near = np.arange(len(scores))
    near = near[ids[near] != own]
    exact = (rows[near] * query).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near[order]], exact[order]


def _tree(vectors: DataFrame, dims: int, total: int) -> Tree:
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    share = min(1.0, SAMPLE / total)
    sample = vectors.where(place <= share).toArrow().sort_by("vec_id")
    if not sample.num_rows:
        sample = vectors.limit(1).toArrow()
    return Tree(matrix(sample.column("vector"), dims), LEAF_ROWS * share)


def _calibrated(placed: DataFrame, tree: Tree, dims: int, total: int, k: int) -> int:
    """Leaves to visit so that the calibration queries find TARGET of their true neighbours."""
    spark = placed.sparkSession
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 31)) / F.lit(float(1 << 31)) <= min(1.0, CALIBRATION / total)
    asked = placed.where(chosen & F.col("candidate")).select("vec_id", "vector").toArrow().sort_by("vec_id")
    if not asked.num_rows:
        return tree.leaves
    queries, own = matrix(asked.column("vector"), dims), asked.column("vec_id").to_numpy()
    shared = spark.sparkContext.broadcast((queries, own))  # about CALIBRATION vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries_, own_ = shared.value
        held = [(np.empty(0, np.int64), np.empty((0, dims)), np.empty(0, np.int64))] * len(own_)
        for batch in batches:
            ids, leaf, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(1), dims)
            for i, (query, me) in enumerate(zip(queries_, own_)):
                all_ids = np.concatenate([held[i][0], ids])
                found, _ = best(query, me, all_ids, np.concatenate([held[i][1], rows]), k)
                at = np.flatnonzero(np.isin(all_ids, found))
                held[i] = (all_ids[at], np.concatenate([held[i][1], rows])[at], np.concatenate([held[i][2], leaf])[at])
        out = [[], [], [], []]
        for i, (ids, rows, leaf) in enumerate(held):
            out[0].extend([i] * len(ids))
            out[1].extend(ids.tolist())
            out[2].extend(leaf.tolist())
            out[3].extend((rows * queries_[i]).sum(axis=1).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["q", "vec_id", "leaf", "score"])

    rows = placed.where("candidate").select("vec_id", "vector", "leaf").mapInArrow(run, "q long, vec_id long, leaf long, score double")
    # At most k rows of each task for each calibration query; the k best of each are merged by Spark.
    top = rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "leaf"))), 1, k).alias("best"))
    needed = []
    for row in top.select("q", "best.leaf").collect():
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(queries[row["q"]], tree.leaves))}
        needed.extend((place[leaf], 1 / len(row["leaf"])) for leaf in row["leaf"])
    needed.sort()
    want, got = TARGET * len({i for i in range(len(own))}), 0.0
    for visits, weight in needed:
        got += weight
        if got >= want:
            return visits
    return tree.leaves


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for all rows whose id is divisible by ``every``."""
    vectors = materialize(valid_vectors(rows, nonzero=True), "vectors")
    dims, total = width(vectors), vectors.count()
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    # At most SAMPLE centres; it travels inside the functions, so executors need no copy of this package.
    tree = _tree(vectors, dims, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    roles = with_roles(vectors, F.col("vec_id") % every == 0, k + 1)
    placed = materialize(roles.mapInArrow(place, "vec_id long, vector array<double>, candidate boolean, query boolean, leaf long"), "placed")
    counted = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("candidate").alias("candidates")).collect()  # one row per leaf
    sizes = {r["leaf"]: r["n"] for r in counted}
    filled = np.zeros(tree.leaves, dtype=np.int64)
    for r in counted:
        filled[r["leaf"]] = r["candidates"]
    base, chunks, shard, held = [], [], 0, 0
    for leaf in range(tree.leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        parts = max(1, -(-n // SHARD_ROWS))
        base.append(shard)
        chunks.append(parts)
        if parts > 1:
            shard, held = shard + parts, 0
        else:
            held += n
    most = _calibrated(placed, tree, dims, total, k)
    layout = spark.sparkContext.broadcast((np.array(base), np.array(chunks), filled))  # one entry per leaf

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, _ = layout.value
        for batch in batches:
            leaf, ids = batch.column(4).to_numpy(), batch.column(0).to_numpy()
            own = first[leaf] + (ids * 0x9E3779B1 >> 7) % parts[leaf]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "shard"])

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        cells = {"shard": [part.column("shard")[0].as_py()]}
        for name, flag in (("", "candidate"), ("q_", "query")):
            own = part.filter(part.column(flag))
            cells |= {f"{name}ids": [own.column("vec_id").to_numpy().tobytes()], f"{name}leaves": [own.column("leaf").to_numpy().tobytes()], f"{name}vectors": [matrix(own.column("vector"), dims).tobytes()]}
        return pa.table(cells, schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in cells if c != "shard"]]))

    blocks = "shard long, ids binary, leaves binary, vectors binary, q_ids binary, q_leaves binary, q_vectors binary"
    dealt = placed.mapInArrow(deal, "vec_id long, vector array<double>, candidate boolean, query boolean, leaf long, shard long")
    shards = materialize(dealt.groupBy("shard").applyInArrow(pack, blocks), "shards")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a shard, packed for every shard that has a leaf they visit."""
        first, parts, candidates = layout.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("q_ids")[i].as_py(), np.int64)
                queries = np.frombuffer(batch.column("q_vectors")[i].as_py()).reshape(-1, dims)
                seen = np.zeros((len(ids), tree.leaves), dtype=bool)
                for j, query in enumerate(queries):
                    seen[j, tree.visits(query, most, candidates, k + 1)] = True
                for target in sorted({int(s) for leaf in np.flatnonzero(seen.any(axis=0)) for s in range(first[leaf], first[leaf] + parts[leaf])}):
                    there = np.flatnonzero((first <= target) & (target < first + parts))
                    some = np.flatnonzero(seen[:, there].any(axis=1))
                    yield pa.RecordBatch.from_pydict(
                        {"shard": [target], "a_ids": [ids[some].tobytes()], "a_vectors": [queries[some].tobytes()], "a_leaves": [there.astype(np.int64).tobytes()], "a_seen": [seen[np.ix_(some, there)].tobytes()]},
                        schema=pa.schema([("shard", pa.int64()), ("a_ids", pa.binary()), ("a_vectors", pa.binary()), ("a_leaves", pa.binary()), ("a_seen", pa.binary())]),
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "shard"}
                ids, leaf = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["leaves"], np.int64)
                vectors_ = np.frombuffer(cell["vectors"]).reshape(-1, dims)
                there = np.frombuffer(cell["a_leaves"], np.int64)
                asked = np.frombuffer(cell["a_ids"], np.int64)
                seen = np.frombuffer(cell["a_seen"], bool).reshape(len(asked), len(there))
                column = np.searchsorted(there, leaf)
                out = [[], [], []]
                for own, query, mark in zip(asked.tolist(), np.frombuffer(cell["a_vectors"]).reshape(-1, dims), seen):
                    open_ = mark[column]
                    some = slice(None) if open_.all() else open_
                    found, scores = best(query, own, ids[some], vectors_[some], k)
                    out[0].append(own)
                    out[1].append(found.tobytes())
                    out[2].append(scores.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["query_id", "ids", "scores"])

    def merge(part: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int64)
        scores = np.frombuffer(b"".join(part.column("scores").to_pylist()))
        order = np.lexsort((ids, -scores))[:k]
        return pa.table({"query_id": pa.array([part.column("query_id")[0].as_py()] * len(order), pa.int64()), "rank": pa.array(range(1, len(order) + 1), pa.int32()), "vec_id": pa.array(ids[order]), "score": pa.array(scores[order])})

    visits = shards.select("q_ids", "q_vectors").repartition(max(1, shard + 1)).mapInArrow(walk, "shard long, a_ids binary, a_vectors binary, a_leaves binary, a_seen binary")
    meet = visits.join(shards.select("shard", "ids", "leaves", "vectors"), "shard")
    found = meet.mapInArrow(search, "query_id long, ids binary, scores binary")
    return found.groupBy("query_id").applyInArrow(merge, result)
