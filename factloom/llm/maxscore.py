"""Exact top-k by integer inner product with MaxScore.

Every component is a term and its postings are the rows of a shard. A term's bound for a query is the
most that any row of the shard can gain from it. The terms are sorted by bound; the longest tail whose
bounds sum to less than the score of a query's k-th row found so far is non-essential: no row can enter
the result by it alone. The postings of essential terms are traversed, then the others are probed only
for rows that can still reach the threshold. Thresholds rise from shard to shard.

Queries go in blocks over each shard, so that essential terms are one matrix product and the terms of a
block share one order. Where the tails rule out too few rows, as among vectors without small components,
probing row by row costs more than a product over all terms: the block then traverses all terms of the
next shards before it tries again. Scores are exact either way. Sums below 2^24 are taken in 32 bits.

A task holds many blocks and streams its share of the rows, the lane, past them, shard by shard. Rows are
sent once while the blocks fit into one task, and queries once per lane. Lanes answer alone and their
results are merged.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null
ids; a shorter vector is filled with zeros; several rows of one id count as one, with the smallest
vector; equal scores go to the smaller id; fewer candidates than k give all of them; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from factloom.llm.vectors import matrix, valid_vectors, width, with_roles
from factloom.session import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
# Components of the queries that a task holds, the rows that make a lane worth while, and lanes for each core.
HELD_VALUES, LANE_ROWS, LANES_PER_CORE = 2**24, 4096, 3
# Queries of one matrix product.
GROUP_QUERIES = 256
TERMS_AT_ONCE = 8
SEEDS = 1024
# Probing pays while it is left with less than this share of all pairs; else all terms are traversed for some shards.
PROBED_SHARE, SHARDS_UNTIL_RETRY = 1 / 64, 16
LOWEST, NO_ID = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles."""
    return np.floor(scale * vectors.astype(np.float64))


def largest_norm(whole: np.ndarray) -> float:
    """The largest squared length of a row."""
    return float(np.einsum("ij,ij->i", whole, whole).max(initial=0))


def exact_type(a: float, b: float) -> type:
    """The fastest type in which all sums of products of two rows of these squared lengths are exact: none is larger than the product of the lengths.

    For doubles 256 times less is allowed than they hold, since bounds are larger than sums.
    """
    if a * b < 2.0**48:
        return np.float32
    return np.float64 if a * b < 2.0**90 else np.int64


class Typed:
    """Rows of integers, turned into the type of a search once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.norm = ids, largest_norm(rows)
        self.rows = rows.astype(np.float32) if self.norm < 2.0**48 else rows
        self._as: dict = {}

    def as_type(self, kind: type) -> np.ndarray:
        if self.rows.dtype == kind:
            return self.rows
        if kind not in self._as:
            self._as = {kind: self.rows.astype(kind)}
        return self._as[kind]


class Block(Typed):
    """Queries and the k best rows that each has met."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        super().__init__(ids, rows)
        self.k, self.wait = k, 0
        self.gains, self.losses = np.maximum(rows, 0).sum(axis=0), np.minimum(rows, 0).sum(axis=0)
        self.scores = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), NO_ID)

    def take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Lets rows enter: ``at`` ascending is the place of the query, ties go to the smaller id."""
        last, tied = self.scores[at, -1], self.found[at, -1]
        keep = (scores > last) | ((scores == last) & (ids < tied))
        at, ids, scores = at[keep], ids[keep], scores[keep]
        if not len(at):
            return
        whose, place = np.unique(at, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(whose)), self.k), place])
        ids = np.concatenate([self.found[whose].ravel(), ids])
        scores = np.concatenate([self.scores[whose].ravel(), scores])
        order = np.lexsort((ids, -scores, place))
        starts = np.searchsorted(place[order], np.arange(len(whose)))
        best = order[np.arange(len(order)) - starts[place[order]] < self.k]
        self.scores[whose], self.found[whose] = scores[best].reshape(-1, self.k), ids[best].reshape(-1, self.k)

    def results(self) -> list[np.ndarray]:
        """query_id, vec_id, score of all rows found."""
        known = self.scores.ravel() > LOWEST
        return [x[known] for x in (np.repeat(self.ids, self.k), self.found.ravel(), self.scores.ravel())]


class Shard(Typed):
    """Postings of the rows of one shard, a line per term, with the extreme values of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids)
        super().__init__(ids[order], rows[order])
        self.postings = np.ascontiguousarray(self.rows.T)
        self.high, self.low = rows.max(axis=0), rows.min(axis=0)

    def search(self, block: Block) -> None:
        """Offers every row to every query of the block but the row's own."""
        kind = exact_type(self.norm, block.norm)
        queries, postings = block.as_type(kind), self.postings.astype(kind, copy=False)
        own = np.minimum(np.searchsorted(self.ids, block.ids), len(self.ids) - 1)
        mine = self.ids[own] == block.ids
        pruned = not block.wait and kind is not np.int64
        if pruned:
            # By the bounds of all queries together: one gains most from the highest value of a term or, if negative, the lowest.
            order = np.argsort(-(block.gains * self.high + block.losses * self.low), kind="stable")
            queries, postings = queries[:, order], postings[order]
        block.wait = max(0, block.wait - 1)
        terms, lowest = len(postings), _lowest(kind)
        room = np.empty((min(GROUP_QUERIES, len(queries)), postings.shape[1]), kind)
        reach = np.empty(room.shape, bool)
        for start in range(0, len(queries), GROUP_QUERIES):
            part = slice(start, start + GROUP_QUERIES)
            asked, least = queries[part], block.scores[part, -1]
            at = np.flatnonzero(mine[part])
            hide = (at, own[part][at])
            essential, met = terms, least.min() > LOWEST
            if pruned and met:
                # Non-essential: the tail whose bounds together stay under the threshold of every query.
                rest = _tails(asked, self.high[order], self.low[order])
                essential = min(max(int(np.count_nonzero((rest >= least[:, None]).any(axis=0))), TERMS_AT_ONCE), terms)
            scores = np.matmul(asked[:, :essential], postings[:essential], out=room[: len(asked)])
            scores[hide] = lowest
            if not met:
                least = np.maximum(least, _seeded(scores, block.k))
            left = scores.size
            if essential < terms:
                limits = (least - rest[:, essential]).astype(kind)
                left = np.count_nonzero(np.greater_equal(scores, limits[:, None], out=reach[: len(asked)]))
                if left > PROBED_SHARE * scores.size:
                    scores += asked[:, essential:] @ postings[essential:]
                    scores[hide] = lowest
                    essential = terms
                else:
                    found = self._probe(*_pairs(scores, reach[: len(asked)]), asked, postings, rest, least, essential)
            if essential == terms:
                # A query without a threshold takes all rows but its own.
                limits = np.where(least > LOWEST, least, lowest // 2 if kind is np.int64 else np.finfo(kind).min).astype(kind)
                found = _pairs(scores, np.greater_equal(scores, limits[:, None], out=reach[: len(asked)]))
            if pruned and met and left > PROBED_SHARE * scores.size:
                pruned, block.wait = False, SHARDS_UNTIL_RETRY
            block.take(found[0] + start, self.ids[found[1]], found[2].astype(np.int64))

    def _probe(self, rows, columns, sums, asked, postings, rest, least, at):
        """The other terms of the rows left, some at once, for rows that can still reach the threshold."""
        while at < len(postings) and len(rows):
            end = min(at + TERMS_AT_ONCE, len(postings))
            sums = sums + np.einsum("ij,ji->i", asked[rows, at:end], postings[at:end, columns])
            keep = sums + rest[rows, end] >= least[rows]
            rows, columns, sums, at = rows[keep], columns[keep], sums[keep], end
        return rows, columns, sums


def _tails(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query the bound of all terms from a place on."""
    rest = np.zeros((len(queries), len(high) + 1))
    rest[:, :-1] = np.cumsum(np.maximum(queries * high, queries * low)[:, ::-1], axis=1)[:, ::-1]
    return rest


def _lowest(kind: type):
    """A score below all others, for a query's own row."""
    return np.iinfo(kind).min // 2 if kind is np.int64 else -np.inf


def _seeded(scores: np.ndarray, k: int) -> np.ndarray:
    """A threshold for queries that have met no rows: the k-th score among the first rows of the shard."""
    if scores.shape[1] <= k:
        return np.full(len(scores), LOWEST)
    return np.partition(scores[:, :SEEDS], -k, axis=1)[:, -k].astype(np.int64)


def _pairs(scores: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and sum of the pairs marked."""
    hit = np.flatnonzero(reach.any(axis=1))
    inside = reach[hit]
    if inside.size % 8:
        row, column = np.nonzero(inside)
    else:
        # Few are marked: eight at once are skipped.
        eights = np.flatnonzero(inside.reshape(-1).view(np.uint64) != 0)
        place, bit = np.nonzero(inside.reshape(-1, 8)[eights])
        row, column = np.divmod(eights[place] * 8 + bit, reach.shape[1])
    return hit[row], column, scores[hit[row], column]


def packed(rows: DataFrame, by: str, dims: int, kind: type) -> DataFrame:
    """One row per group: its ids and vectors as two blocks of bytes. Groups have a bounded size."""

    def run(part: pa.Table) -> pa.Table:
        return pa.table({
            by: pa.array([part.column(by)[0].as_py()], pa.int64()),
            "ids": pa.array([part.column("vec_id").to_numpy().tobytes()], pa.large_binary()),
            "vectors": pa.array([matrix(part.column("vector"), dims).astype(kind).tobytes()], pa.large_binary()),
        }).cast(pa.schema([(by, pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return rows.groupBy(by).applyInArrow(run, f"{by} long, ids binary, vectors binary")


def shards_of(rows: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stream of ids and vectors, cut anew into parts of ``size`` rows and a smaller last one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in rows:
        held.append(part)
        if sum(len(ids) for ids, _ in held) >= size:
            ids, vectors = (np.concatenate(x) for x in zip(*held))
            whole = len(ids) - len(ids) % size
            for start in range(0, whole, size):
                yield ids[start : start + size], vectors[start : start + size]
            held = [(ids[whole:], vectors[whole:])]
    if sum(len(ids) for ids, _ in held):
        yield tuple(np.concatenate(x) for x in zip(*held))


def top_products(rows: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for all rows whose id is divisible by ``every``, against all rows but their own."""
    given = rows.schema["embedding"].dataType
    narrow = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind, shard_rows = np.float32 if narrow else np.float64, SHARD_ROWS
    vectors = materialize(valid_vectors(rows, nonzero=False, component="float" if narrow else "double"), "vectors")
    chosen = F.col("vec_id") % every == 0
    dims, counts = width(vectors), vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(chosen).alias("queries")).first()
    if not dims:
        return vectors.where("false").selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0L AS score")
    roles = with_roles(vectors, chosen, k + 1)
    packs = max(1, -(-counts["queries"] // BLOCK_QUERIES))
    holders = -(-packs * BLOCK_QUERIES * dims // max(HELD_VALUES, BLOCK_QUERIES * dims))
    wanted = -(-LANES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism // holders)
    lanes = max(1, min(wanted, counts["rows"] // LANE_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A task is one lane of rows before one holder of packs of queries; the queries have no vec_id and so are sorted to its beginning.
    asked = packed(roles.where("query").withColumn("pack", deal(packs)), "pack", dims, kind).select("*", each(lanes).alias("lane"))
    asked = asked.select("ids", "vectors", (F.col("pack") % holders * lanes + F.col("lane")).cast("int").alias("task"))
    candidates = roles.where("candidate").select("vec_id", "vector", deal(lanes).alias("lane"), each(holders).alias("holder"))
    candidates = candidates.select("vec_id", "vector", (F.col("holder") * lanes + F.col("lane")).cast("int").alias("task"))
    dealt = candidates.unionByName(asked, allowMissingColumns=True).repartitionById(holders * lanes, F.col("task")).sortWithinPartitions("vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []

        def lane() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = batch.column("vec_id")
                for own, cells in zip(batch.column("ids")[: ids.null_count], batch.column("vectors")[: ids.null_count]):
                    blocks.append(Block(np.frombuffer(own.as_py(), np.int64), integers(np.frombuffer(cells.as_py(), kind).reshape(-1, dims), scale), k))
                left = batch.slice(ids.null_count)
                yield left.column("vec_id").to_numpy(), matrix(left.column("vector"), dims).astype(kind, copy=False)

        for ids, vectors in shards_of(lane(), shard_rows):
            shard = Shard(ids, integers(vectors, scale))
            for block in blocks:
                shard.search(block)
        for block in blocks:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in block.results()], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
