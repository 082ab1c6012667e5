"""Order-dependent results without a single-task sort.

Everything that needs a global order (ranks, running totals, exact quantiles)
goes through two devices here:

* ``ordered_prefix``: equal values are collapsed first, the distinct values are
  cut into buckets by approximate quantiles, and the running total inside a
  bucket is shifted by the total of the lower buckets. The cut points only
  balance the work; the totals are exact whatever they are.
* ``exact_quantiles``: a quantile sketch with a guaranteed rank error brackets
  each wanted quantile, rows outside the brackets are only counted, and the
  values inside the brackets are the only ones that are shuffled and sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col, fused_agg
from factloom.session import materialize

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 10_000
SKETCH_ACCURACY = 20_000
BRACKET = 2.0 / SKETCH_ACCURACY
# Below this size a bracket would be narrower than two ranks, so all values are kept.
KEEP_ALL_ROWS = 2 * SKETCH_ACCURACY
MAX_BROADCAST_GROUPS = 10_000
MAX_BROADCAST_SUMS = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """A broadcast hint only after counting the rows; beyond the limit a hint to join by shuffle, whatever the planner's guess of the size."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def range_slots(values: DataFrame, keys: Sequence[str], slot: str = "_slot", written: bool = False) -> DataFrame:
    """The rows of unique keys cut into numbered ranges in the order of the keys, written once.

    The ranges hold about ``ROWS_PER_BUCKET`` rows each however the keys are spread.
    """
    held = values if written else materialize(values, "values")
    parts = -(-held.count() // ROWS_PER_BUCKET)
    if parts <= 1:
        return held.withColumn(slot, F.lit(0))
    # Written, so that a range keeps its number.
    return materialize(held.repartitionByRange(parts, *keys).withColumn(slot, F.spark_partition_id()), "ranges")


def _bucketed(counts: DataFrame, value: str, rows: int) -> tuple[DataFrame, int]:
    buckets = max(1, min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET)))
    if buckets == 1:
        return counts.withColumn("_bucket", F.lit(0.0)), 1
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(
        F.percentile_approx(col(value), probs, max(SKETCH_ACCURACY, 20 * buckets)).alias("c")
    ).first()["c"]
    edges = sorted({float(c) for c in cuts or []})
    if not edges:
        return counts.withColumn("_bucket", F.lit(0.0)), 1
    splits = [float("-inf"), *edges, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep")
    return cutter.transform(counts), len(edges) + 1


def _with_bases(cut: DataFrame, totals: Sequence[str], by: Sequence[str], buckets: int) -> DataFrame:
    """Add per row the total of the lower buckets and of all buckets."""
    sums = cut.groupBy(*by, "_slot").agg(*[F.sum(t).alias(f"_part_{t}") for t in totals])
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(
        *by,
        "_slot",
        *[F.coalesce(F.sum(f"_part_{t}").over(before), F.lit(0)).alias(f"_base_{t}") for t in totals],
        *[F.sum(f"_part_{t}").over(whole).alias(f"all_{t}") for t in totals],
    )
    groups = cut.select(*by).distinct().limit(MAX_BROADCAST_GROUPS + 1).count() if by else 1
    if groups <= MAX_BROADCAST_GROUPS and groups * buckets <= MAX_BROADCAST_SUMS:
        sums = F.broadcast(sums)
    condition = F.lit(True)
    for key in [*by, "_slot"]:
        condition = condition & F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}"))
    return cut.alias("_l").join(sums.alias("_r"), condition).select(
        "_l.*", *[F.col(f"_r._base_{t}") for t in totals], *[F.col(f"_r.all_{t}") for t in totals]
    )


def ordered_prefix(
    counts: DataFrame,
    value: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<t>`` (running total up to and including equal values) and ``all_<t>``.

    ``counts`` holds weights per value and may hold several rows for one value
    (for instance one per experiment group); ``by`` restarts the totals. It
    should already be collapsed by a ``groupBy`` on the value.
    """
    counts = materialize(counts, "counts")
    size = counts.select(F.count(F.lit(1)).alias("n")).first()["n"]
    cut, buckets = _bucketed(counts, value, size)
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    cut = cut.withColumn("_slot", F.col("_bucket") * sign)
    whole = Window.partitionBy(*by)
    if buckets == 1:
        joined = cut.select(
            "*",
            *[F.lit(0).alias(f"_base_{t}") for t in totals],
            *[F.sum(t).over(whole).alias(f"all_{t}") for t in totals],
        )
    else:
        joined = _with_bases(cut, totals, by, buckets)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*by, "_slot").orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined.select(
        *[col(c) for c in counts.columns],
        *[(F.sum(t).over(inside) + F.col(f"_base_{t}")).alias(f"cum_{t}") for t in totals],
        *[F.col(f"all_{t}") for t in totals],
        "_slot",
    )


def positions(df: DataFrame, by: Sequence[str], order: str, name: str = "position") -> DataFrame:
    """Adds the place of each row in the order of a unique number, restarting per key.

    Unlike a window per key, a key that holds most of the rows is cut into buckets.
    """
    keys = [*by, order]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_one"))
    placed = ordered_prefix(counts, order, ["_one"], by).select(*keys, F.col("cum__one").alias(name))
    return df.join(placed, keys)


def tie_totals(prefixed: DataFrame, value: str, total: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``tie_<total>``: the weight of all rows that share the value."""
    same = Window.partitionBy(*by, "_slot", value)
    return prefixed.withColumn(f"tie_{total}", F.sum(total).over(same))


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, value, groups) with its count ``n``, ``tie_n`` and average rank ``rank``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value, *groups).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = tie_totals(ordered_prefix(counts, value, ["n"], by), value, "n", by)
    return ranked.withColumn("rank", F.col("cum_n") - (F.col("tie_n") - 1) / F.lit(2.0)).drop("_slot")


def rank_sums(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, rank sum; repeated on each row: pooled N and the tie term sum(t^3 - t)."""
    ranked = average_ranks(df, value, [group], by)
    tie = F.col("tie_n").cast("double")
    per_group = ranked.groupBy(*by, group).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.max("all_n").alias("total_n"),
        F.sum(F.col("n") * (tie * tie - 1.0)).alias("_tie_part"),
    )
    pooled = Window.partitionBy(*by)
    return per_group.withColumn("tie_term", F.sum("_tie_part").over(pooled)).drop("_tie_part")


def _brackets(data: DataFrame, width: int, asked: Sequence[float], by: Sequence[str]) -> tuple[DataFrame, dict, int]:
    """The data with edge arrays per column, values surely at or beyond each wanted quantile, and the most rows behind one."""
    low = [max(0.0, p - BRACKET) for p in asked]
    high = [min(1.0, p + BRACKET) for p in asked]
    wide = F.array(*[F.lit(float("-inf"))] * len(asked), *[F.lit(float("inf"))] * len(asked))
    sketch = [
        F.when(F.count(F.col(f"_v{i}")) <= KEEP_ALL_ROWS, wide)
        .otherwise(F.percentile_approx(F.col(f"_v{i}"), low + high, SKETCH_ACCURACY))
        .alias(f"_q{i}")
        for i in range(width)
    ]
    k = len(asked)
    rows = F.count(F.lit(1)).alias("_rows")
    if not by:
        found = fused_agg(data, [rows, *sketch])
        return data, {i: [(F.lit(found[f"_q{i}"][j]), F.lit(found[f"_q{i}"][k + j])) for j in range(k)] for i in range(width)}, found["_rows"]
    edges = materialize(data.groupBy(*[col(b) for b in by]).agg(rows, *sketch), "edges")
    most = edges.agg(F.max("_rows").alias("n")).first()["n"] or 0
    edges = broadcast_if_small(edges)
    match = None
    for b in by:
        test = F.col(f"_l.{b}").eqNullSafe(F.col(f"_r.{b}"))
        match = test if match is None else match & test
    joined = data.alias("_l").join(edges.alias("_r"), match).select(
        "_l.*", *[F.col(f"_r._q{i}") for i in range(width)]
    )
    return joined, {i: [(F.col(f"_q{i}")[j], F.col(f"_q{i}")[k + j]) for j in range(k)] for i in range(width)}, most


def _running_counts(values: DataFrame, by: Sequence[str], sorted_at_once: bool) -> DataFrame:
    """Adds ``_cum``: how many values of the bracket are at or below each distinct one."""
    group = [*by, "column", "_j"]
    upto = (Window.unboundedPreceding, Window.currentRow)
    if sorted_at_once:
        return values.withColumn("_cum", F.sum("_n").over(Window.partitionBy(*[col(g) for g in group]).orderBy("_key").rowsBetween(*upto)))
    cut = range_slots(values, [*group, "_key"])
    inside = Window.partitionBy(*[col(g) for g in group], "_slot").orderBy("_key").rowsBetween(*upto)
    joined = _with_bases(cut, ["_n"], group, cut.agg(F.max("_slot").alias("s")).first()["s"] or 1)
    return joined.withColumn("_cum", F.sum("_n").over(inside) + F.col("_base__n")).drop("_slot", "_base__n", "all__n")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (by, column).

    Groups of up to ``KEEP_ALL_ROWS`` rows are sorted as arrays after one shuffle. The others, and all rows
    where there are no groups, take three narrow scans: a sketch for the brackets, one aggregate that counts
    the rows below and on the edges, and a pass over the values strictly
    inside. A bracket holds about 4 in 20,000 of the rows. Where that may be
    more than one task should sort, the distinct values are cut into ranges of
    bounded size, each shifted by the count of the lower ones.
    """
    data = df.select(*[col(b) for b in by], *[as_double(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    if not by:
        return _bracketed_quantiles(data, columns, probs, by)
    sizes = materialize(data.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    large = sizes.where(F.col("_rows") > KEEP_ALL_ROWS).drop("_rows")
    if not large.limit(1).count():
        return _small_quantiles(data, columns, probs, by)
    match = F.lit(True)
    for b in by:
        match = match & F.col(f"_l.{b}").eqNullSafe(F.col(f"_r.{b}"))
    rows, groups = data.alias("_l"), broadcast_if_small(large).alias("_r")
    small = _small_quantiles(rows.join(groups, match, "left_anti"), columns, probs, by)
    return _bracketed_quantiles(rows.join(groups, match, "left_semi"), columns, probs, by).unionByName(small)


def _small_quantiles(data: DataFrame, columns: Sequence[str], probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """``exact_quantiles`` of groups of bounded size; column i is ``_v<i>`` of ``data``."""
    keys = [col(b) for b in by]
    held = data.groupBy(*keys).agg(*[F.sort_array(F.collect_list(f"_v{i}")).alias(f"_v{i}") for i in range(len(columns))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.size(f"_v{i}").cast("long").alias("n"), F.col(f"_v{i}").alias("_v")) for i, c in enumerate(columns)])
    long = held.select(*keys, F.inline(cells)).where("n > 0")

    def value(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.get("_v", F.floor(place).cast("int")), F.get("_v", F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return long.select(*keys, "column", "n", *[value(p).alias(x) for x, p in probs.items()])


def _bracketed_quantiles(data: DataFrame, columns: Sequence[str], probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """``exact_quantiles`` by brackets; column i is ``_v<i>`` of ``data``."""
    labels = list(probs)
    data, edges, most = _brackets(data, len(columns), [probs[x] for x in labels], by)

    counts, records, cells = [], [], []
    for i, name in enumerate(columns):
        v = F.col(f"_v{i}")
        counts.append(F.count(v).alias(f"_n{i}"))
        for j, label in enumerate(labels):
            lo, hi = edges[i][j]
            key = f"{i}_{j}"
            counts += [
                F.count_if(v < lo).alias(f"_b{key}"),
                F.count_if(v == lo).alias(f"_e{key}"),
                F.max(lo).alias(f"_l{key}"),
                F.max(hi).alias(f"_h{key}"),
            ]
            records.append(
                F.struct(
                    F.lit(name).alias("column"), F.lit(j).alias("_j"), F.lit(probs[label]).alias("_p"),
                    F.col(f"_n{i}").alias("n"), F.col(f"_b{key}").alias("_below"), F.col(f"_e{key}").alias("_equal"),
                    F.col(f"_l{key}").alias("_lo"), F.col(f"_h{key}").alias("_hi"),
                )
            )
            inside = (v > lo) & (v < hi)
            cells.append(F.when(inside, F.struct(F.lit(name).alias("column"), F.lit(j).alias("_j"), v.alias("_key"))))
    keys = [col(b) for b in by]
    wanted = data.groupBy(*keys).agg(*counts).select(*keys, F.inline(F.array(*records))).filter(F.col("n") > 0)

    any_inside = cells[0].isNotNull()
    for c in cells[1:]:
        any_inside = any_inside | c.isNotNull()
    kept = data.filter(any_inside).select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("_c"))
    values = kept.groupBy(*keys, "_c.column", "_c._j", "_c._key").agg(F.count(F.lit(1)).alias("_n"))
    # A bracket and the error of its sketch at both ends, as a share of the rows, bound what it holds.
    at_once = most * (2 * BRACKET + 2 / SKETCH_ACCURACY) <= ROWS_PER_BUCKET
    values = _running_counts(values, by, at_once)

    match = (F.col("_w.column") == F.col("_x.column")) & (F.col("_w._j") == F.col("_x._j"))
    for b in by:
        match = match & F.col(f"_w.{b}").eqNullSafe(F.col(f"_x.{b}"))
    start, place = F.col("_below") + F.col("_equal"), F.col("_p") * (F.col("n") - 1)

    def hit(position: Column) -> Column:
        return (start + F.col("_cum") - F.col("_n") <= position) & (position < start + F.col("_cum"))

    if not at_once:
        # The one or two values at each place are found before any of them meet in one task.
        wanted = materialize(wanted, "wanted")
        places = broadcast_if_small(wanted)
        values = values.alias("_x").join(places.alias("_w"), match).where(hit(F.floor(place)) | hit(F.ceil(place))).select("_x.*")
    both = wanted.alias("_w").join(values.alias("_x"), match, "left").select("_w.*", "_x._key", "_x._n", "_x._cum")

    def at(position: Column) -> Column:
        return F.max(F.when(hit(position), F.col("_key")))

    facts = ["n", "_p", "_below", "_equal", "_lo", "_hi"]
    spots = both.groupBy(*keys, "column", "_j", *facts).agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_z"))

    def value(position: Column, found: str) -> Column:
        off = F.raise_error(F.lit("quantile sketch error above its bound")).cast("double")
        edge = F.when(position < F.col("_below"), off).when(position < start, F.col("_lo")).otherwise(F.col("_hi"))
        return F.coalesce(F.col(found), edge)

    low, high = value(F.floor(place), "_a"), value(F.ceil(place), "_z")
    spots = spots.withColumn("_value", low + (high - low) * (place - F.floor(place)))
    return spots.groupBy(*keys, "column").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_j") == j, F.col("_value"))).alias(x) for j, x in enumerate(labels)]
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """The same, as a small dict for plans: {column: {label: value}}."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, probs).collect()
    return {r["column"]: {label: r[label] for label in probs} for r in rows}


def top_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """Share of the total held by the largest ``share`` of the rows (at least one row).

    Null values count as rows but carry nothing, as a sort with nulls last would.
    """
    rows = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    take = max(1, int(rows * share))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    prefixed = ordered_prefix(counts, "value", ["n"], descending=True)
    first = F.greatest(
        F.lit(0), F.least(F.col("n"), F.lit(take) - (F.col("cum_n") - F.col("n")))
    )
    return prefixed.agg(
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(take).cast("bigint").alias("top_rows"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
        F.sum(F.col("value") * first).alias("top_total"),
        F.min("value").alias("smallest"),
    ).withColumn("top_share", F.col("top_total") / F.col("total"))
