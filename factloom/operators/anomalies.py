"""Unusual records: robust z scores and an isolation forest grown from a fixed-size sample."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col, fused_agg, numeric_columns
from factloom.operators.order import column_quantiles
from factloom.session import deal, materialize

# Limits of the detectors.
EXTREME_Z, MAD_SCALE = 8.0, 1.4826
TREES, SAMPLE_PER_TREE, CONTAMINATION = 200, 256, 0.02
MIN_ROWS = 50
MERGED_MASKS = 1024
EULER_GAMMA = 0.5772156649015329


def _filled(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Nulls at the column median, and the medians."""
    medians = {n: q["median"] for n, q in column_quantiles(df, names, {"median": 0.5}).items()}
    out = df.withColumns(
        {n: F.coalesce(as_double(df, n), F.lit(medians.get(n, 0.0))) for n in names}
    )
    return out, medians


def robust_z(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Adds ``z_max``, ``extreme`` and ``reason`` (the most deviant column of the row)."""
    filled, reason = _deviations(df, list(names) if names is not None else numeric_columns(df))
    return filled.withColumn("extreme", F.col("z_max") > EXTREME_Z).withColumn("reason", reason)


def _deviations(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """The filled rows with ``z_max``, and the reason as an expression over them."""
    filled, medians = _filled(df, names)
    deviations = filled.select(*[F.abs(col(n) - F.lit(medians.get(n, 0.0))).alias(n) for n in names])
    mads = {n: q["median"] for n, q in column_quantiles(deviations, names, {"median": 0.5}).items()}
    # Only a column whose values are mostly one and the same falls back on its spread.
    flat = [n for n in names if not mads.get(n)]
    spread = dict(zip(flat, fused_agg(filled, [F.stddev_samp(col(n)).alias(f"s{i}") for i, n in enumerate(flat)]).values()))
    scores: list[Column] = []
    for n in names:
        scale = MAD_SCALE * mads.get(n, 0.0) or spread.get(n) or 1.0
        scores.append(F.abs((col(n) - F.lit(medians.get(n, 0.0))) / F.lit(scale)))
    values = F.array(*scores)
    best = F.array_max(values)
    reason = F.lit(None).cast("string")
    for n, z in reversed(list(zip(names, scores))):
        text = F.concat(
            F.lit(f"{n} = "), F.format_number(col(n), 2),
            F.lit(f" (typical is about {medians.get(n, 0.0):,.2f})"),
        )
        reason = F.when(z == F.col("z_max"), text).otherwise(reason)
    return filled.withColumn("z_max", best), reason


def _expected_path(n: float) -> float:
    """Average unsuccessful search depth in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits of one sample, listed as (node, feature, threshold, left, right, path)."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(values)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or usable.size == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _expected_path(len(rows))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= cut
        nodes.append((node, feature, cut, free, free + 1, 0.0))
        todo.append((free, rows[left], depth + 1))
        todo.append((free + 1, rows[~left], depth + 1))
        free += 2
    return nodes


def _draw_limits(share: float) -> list[float]:
    """Below the k-th limit an even number from 0 to 1 means at most k draws of all trees, each with probability ``share``."""
    if share >= 1:
        return [0.0] * TREES
    limits, chance, total = [], (1 - share) ** TREES, 0.0
    for k in range(TREES):
        total += chance
        limits.append(total)
        chance *= (TREES - k) / (k + 1) * share / (1 - share)
        if chance < 1e-15 and total > 0.5:
            break
    return limits


def _forest_sample(data: DataFrame, rows: int, names: Sequence[str]) -> tuple[DataFrame, int]:
    """(tree, features): up to 256 rows per tree, drawn by a hash of the row's place.

    ``data`` must be read from files, so that a row keeps its place when a
    task runs again; copies of one row are drawn independently.
    """
    size = min(SAMPLE_PER_TREE, rows)
    keyed = data.select(*[col(n) for n in names], F.monotonically_increasing_id().alias("_key"))
    share = min(1.0, 2.0 * size / rows + 40.0 / rows)
    # One hash says how many trees draw a row (a binomial number), two more which ones: a walk through all trees by a step that has
    # no divisor in common with their number. A row is copied only for the trees that draw it.
    least = F.array(*[F.lit(x) for x in _draw_limits(share)])
    even = F.shiftrightunsigned(F.xxhash64("_key"), 11) / F.lit(2.0**53)
    draws = F.size(F.filter(least, lambda x: F.col("_even") >= x))
    steps = [k for k in range(1, TREES) if math.gcd(k, TREES) == 1]
    step = F.element_at(F.array(*[F.lit(k) for k in steps]), (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(len(steps))) + 1).cast("int"))
    start = F.pmod(F.xxhash64("_key", F.lit(2)), F.lit(TREES))
    drawn = keyed.withColumn("_even", even).withColumn("_draws", draws).filter("_draws > 0").withColumns({"_start": start, "_step": step})
    picked = drawn.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)))
    picked = picked.withColumn("tree", ((F.col("_start") + F.col("_draw") * F.col("_step")) % TREES).cast("int")).drop("_even", "_draws", "_start", "_step", "_draw")
    picked = picked.withColumn("_pick", F.xxhash64("_key", "tree"))
    order = Window.partitionBy("tree").orderBy("_pick", "_key")
    picked = picked.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= size)
    return picked, size


def isolation_trees(data: DataFrame, rows: int, names: Sequence[str]) -> tuple[pd.DataFrame, int]:
    """Nodes of all trees, grown in parallel; at most 200 trees of 511 nodes."""
    sample, size = _forest_sample(data, rows, names)
    limit = math.ceil(math.log2(max(size, 2)))
    columns = list(names)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        part = part.sort_values(["_rn"])
        nodes = _grow(part[columns].to_numpy(dtype=float), np.random.default_rng(tree), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, path double"
    nodes = sample.groupBy("tree").applyInPandas(grow, schema).toPandas()
    return nodes, size


def leaf_masks(nodes: pd.DataFrame, features: int) -> tuple[list, list]:
    """What ``mean_path`` needs: per tree its leaf paths and masks, and the cuts of all trees.

    The leaves of a tree are numbered from left to right. A node whose test fails rules out the
    leaves of its left side. Per tree and feature the cuts are sorted, and entry k of the masks is what
    the k lowest cuts leave when they fail; the first bit left by all features is the row's leaf. The
    cuts of all trees are sorted together once per feature, so a value is searched for once. Masks of features whose
    combinations are few are merged into one table, which is looked up once for all of them.
    """
    paths, masks, cuts = [], [], [[] for _ in range(features)]
    for _, part in nodes.groupby("tree"):
        feature, cut, left, right, path = (part.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        span, leaves = _leaf_spans(feature, left, right)
        words = -(-len(leaves) // 64)
        tables = []
        for f in range(features):
            inner = np.flatnonzero(feature == f)
            inner = inner[np.argsort(cut[inner], kind="stable")]
            table = np.full((len(inner) + 1, words), ~np.uint64(0))
            for k, node in enumerate(inner.tolist()):
                low, high = span[left[node]]
                gone = ((1 << (high - low)) - 1) << low
                table[k + 1] = table[k] & ~np.array([gone >> 64 * w & 0xFFFFFFFFFFFFFFFF for w in range(words)], dtype=np.uint64)
            tables.append(table)
            cuts[f].append(cut[inner])
        paths.append(path[leaves])
        masks.append(tables)
    every = [np.sort(np.concatenate(c)) for c in cuts]
    # How many of a tree's cuts lie below each place among all cuts of the feature.
    below = [[np.searchsorted(own, np.append(together, np.inf), side="left").astype(np.uint16) for own in c] for c, together in zip(cuts, every)]
    return [(path, _merged(tables, [own[t] for own in below])) for t, (path, tables) in enumerate(zip(paths, masks))], every


def _merged(tables: Sequence[np.ndarray], below: Sequence[np.ndarray]) -> list[tuple[list, list]]:
    """Per group of features: (feature, its part of the place in the table) and the words of the table."""
    groups: list[tuple[list, np.ndarray]] = []
    for f, table in enumerate(tables):
        size = len(table)
        if size == 1:
            continue
        if groups and len(groups[-1][1]) * size <= MERGED_MASKS:
            parts, ahead = groups[-1]
            both = (ahead[:, None, :] & table[None, :, :]).reshape(-1, table.shape[1])
            groups[-1] = ([*[(g, own * np.uint16(size)) for g, own in parts], (f, below[f])], both)
        else:
            groups.append(([(f, below[f])], table))
    return [(parts, [np.ascontiguousarray(word) for word in table.T]) for parts, table in groups]


def mean_path(forest: tuple[list, list], values: np.ndarray) -> np.ndarray:
    """Mean path of each row by bit vectors over the leaves of each tree, without walking it."""
    trees, every = forest
    ranks = [np.searchsorted(together, values[:, f], side="left") for f, together in enumerate(every)]
    total = np.zeros(len(values))
    for path, groups in trees:
        left = None
        for parts, words in groups:
            at = sum(own.take(ranks[f]).astype(np.intp) for f, own in parts)
            found = [word.take(at) for word in words]
            left = found if left is None else [a & b for a, b in zip(left, found)]
        total += path.take(_first_bit(left)) if left is not None else path[0]
    return total / len(trees)


def _leaf_spans(feature: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Per node the range of its leaves, and the nodes that are leaves, from left to right."""
    span, leaves, todo = {}, [], [(0, False)]
    while todo:
        node, done = todo.pop()
        if feature[node] < 0:
            span[node] = (len(leaves), len(leaves) + 1)
            leaves.append(node)
        elif done:
            span[node] = (span[left[node]][0], span[right[node]][1])
        else:
            todo += [(node, True), (int(right[node]), False), (int(left[node]), False)]
    return span, leaves


def _first_bit(words: Sequence[np.ndarray]) -> np.ndarray:
    """Number of the lowest set bit of each row, whose words lie in as many arrays. The word is chosen first, so bits are counted once."""
    word, ahead = words[-1], np.uint16(64 * (len(words) - 1))
    for w in reversed(range(len(words) - 1)):
        held = words[w] != 0
        word, ahead = np.where(held, words[w], word), np.where(held, np.uint16(64 * w), ahead)
    return np.bitwise_count(~word & (word - np.uint64(1))) + ahead


def isolation_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds ``anomaly_score`` in (0, 1); larger is easier to isolate. Reads a materialized table."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    nodes, size = isolation_trees(df, rows, names)
    shared = df.sparkSession.sparkContext.broadcast((leaf_masks(nodes, len(names)), _expected_path(size)))  # at most TREES trees of 511 nodes
    columns = list(names)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest, norm = shared.value
        for cells in parts:
            values = np.column_stack([c.to_numpy(dtype=float) for c in cells])
            yield pd.Series(np.power(2.0, -mean_path(forest, values) / (norm or 1.0)))

    return df.withColumn("anomaly_score", score(*[col(c) for c in columns]))


def anomalies(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame | None:
    """Adds score, extreme, reason and ``is_anomaly``; None for fewer than 50 rows or no numbers."""
    names = list(names) if names is not None else numeric_columns(df)
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not names or rows < MIN_ROWS:
        return None
    filled, reason = _deviations(df, names)
    base = materialize(deal(filled, rows), "robust")
    scored = materialize(isolation_scores(base, names), "anomaly")
    # The texts are made where they are read, not written and carried through the scoring.
    scored = scored.select(*[col(c) for c in base.columns], (F.col("z_max") > EXTREME_Z).alias("extreme"), reason.alias("reason"), "anomaly_score")
    cut = column_quantiles(scored, ["anomaly_score"], {"cut": 1 - CONTAMINATION})["anomaly_score"]["cut"]
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)) | F.col("extreme"))


def top_anomalies(flagged: DataFrame, k: int = 10) -> DataFrame:
    return flagged.orderBy(F.desc("extreme"), F.desc("anomaly_score"), F.desc("z_max")).limit(k)


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("is_anomaly").alias("count"),
        F.avg(F.col("is_anomaly").cast("double")).alias("share"),
        F.count_if("extreme").alias("extreme_count"),
    )
