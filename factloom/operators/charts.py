"""Data behind the exploratory charts; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import (
    as_double,
    categorical_columns,
    clean_value,
    col,
    finite_double,
    is_numeric,
    long_rows,
    long_values,
    numeric_columns,
    pearson,
    to_number,
)
from factloom.operators.order import broadcast_if_small, exact_quantiles, ordered_prefix, range_slots
from factloom.operators.profile import few_valued
from factloom.operators.segments import segment_labels
from factloom.session import materialize

# Bins and positive words.
BINS = 30
POSITIVE_VALUES = ("yes", "true", "1", "churn", "positive", "y", "default", "attrition")
TIER_ORDER = ("High", "Medium", "Low")


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the last is closed, and edges decide where the division rounds."""
    step = (high - low) / bins
    raw = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    down = F.when(value < low + raw * step, 1).otherwise(0)
    up = F.when((value >= low + (raw + 1) * step) & (raw < bins - 1), 1).otherwise(0)
    return (raw - down + up).cast("int")


def histograms(df: DataFrame, names: Sequence[str], bins: int = BINS, split_by: str | None = None) -> DataFrame:
    """(column, [split], bin, lower, upper, n) with empty bins kept.

    With ``split_by`` the populations share the bins, as an overlay needs.
    """
    keep = ["_split"] if split_by else []
    data = df.withColumn("_split", col(split_by)) if split_by else df
    cells = long_values(data, names, "double", keep)
    edges = cells.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = F.col("lo") == F.col("hi")
    edges = edges.select(
        "column",
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    binned = cells.join(F.broadcast(edges), "column").select(
        "column", *keep, _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    )
    counts = binned.groupBy("column", *keep, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = counts.select("column", *keep).distinct().join(F.broadcast(edges), "column")
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, ["column", *keep, "bin"], "left").select(
        "column",
        *([F.col("_split").alias(split_by)] if split_by else []),
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step)
        .alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(left, right, r) for each pair of the named columns, all in one aggregate."""
    cells = {n: as_double(df, n) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = df.agg(
        *[
            F.nanvl(
                pearson(cells[a], cells[b]),
                F.lit(None).cast("double"),
            ).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    records = [(a, [F.lit(b), F.col(f"r{i}")]) for i, (a, b) in enumerate(pairs)]
    return long_rows(wide, records, ["right", "r"], key="left")


def correlation_matrix(df: DataFrame, target: str | None = None) -> DataFrame:
    names = numeric_columns(df, [target] if target else [])
    if target and is_numeric(df.schema[target].dataType):
        names = [*names, target]
    return correlations(df, names)


def strong_pairs(df: DataFrame, names: Sequence[str], limit: int = 2, floor: float = 0.5) -> DataFrame:
    """The most correlated pairs above ``floor`` in absolute value."""
    return (
        correlations(df, list(names))
        .filter(F.abs("r") > floor)
        .orderBy(F.desc(F.abs("r")), F.desc("left"), F.desc("right"))
        .limit(limit)
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts per value up to 10 values, else a 30-bin histogram; (value, lower, upper, n)."""
    few = few_valued(df, [target]).get(target)
    if few is not None and few <= 10:
        present = df.filter(clean_value(target, df.schema[target].dataType).isNotNull())
        return present.groupBy(col(target).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        ).select(
            "value", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), "n"
        )
    return histograms(df, [target]).select(F.col("bin").cast("string").alias("value"), "lower", "upper", "n")


def target_as_number(df: DataFrame, target: str) -> Column:
    """0/1 for two-valued text (positive word, else the smaller value), else the number."""
    dtype = df.schema[target].dataType
    if is_numeric(dtype):
        return as_double(df, target)
    text = col(target).cast("string")
    bounds = df.agg(F.min(text).alias("a"), F.max(text).alias("b")).first()
    a, b = bounds["a"], bounds["b"]
    two = a is not None and a != b and not df.filter(~text.isin(a, b)).limit(1).count()
    if not two:
        return to_number(text)
    positive = next((v for v in (a, b) if v.lower().strip() in POSITIVE_VALUES), a)
    return F.when(text.isNotNull(), (text == positive).cast("double")).otherwise(F.lit(0.0))


def category_rates(df: DataFrame, target: str) -> DataFrame:
    """Mean of the target per category value, times 100, for the few-valued categorical columns."""
    texts = [c for c in categorical_columns(df, [target]) if isinstance(df.schema[c].dataType, T.StringType)]
    counts = few_valued(df, texts)
    chosen = [c for c in texts if 2 <= counts.get(c, 0) <= 20]
    if not chosen:
        # A column outside the few-valued ones has more than one value for sure.
        chosen = [c for c in texts if counts.get(c, 2) > 1]
    data = df.withColumn("_y", target_as_number(df, target)).filter(F.col("_y").isNotNull())
    return (
        long_values(data, chosen, "string", ["_y"])
        .groupBy("column", "value")
        .agg((F.avg("_y") * 100).alias("rate"), F.count(F.lit(1)).alias("n"))
    )


def box_stats(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per target value for numeric columns."""
    names = list(names) if names is not None else numeric_columns(df, [target])
    data = df.select(col(target).cast("string").alias("_target"), *[col(n) for n in names])
    boxes = exact_quantiles(data, names, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["_target"])
    boxes = materialize(boxes, "boxes")
    cells = long_values(data, names, "double", ["_target"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    whiskers = (
        cells.join(broadcast_if_small(boxes), ["_target", "column"])
        .filter(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
        .groupBy("_target", "column")
        .agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    )
    return boxes.join(whiskers, ["_target", "column"]).select(
        F.col("_target").alias("target_value"),
        "column", "n", "q1", "median", "q3", "whisker_low", "whisker_high",
    )


def segment_rates(df: DataFrame, target: str, positive: str, by: str) -> DataFrame:
    """Share of the positive label per value (or quartile of a many-valued number)."""
    data = df.select(
        segment_labels(df, by).alias("segment"),
        F.coalesce((col(target).cast("string") == positive).cast("double"), F.lit(0.0)).alias("y"),
    )
    return data.groupBy("segment").agg(F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))


def gains_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Cumulative capture by descending score, one point per distinct score.

    ``label`` is 0/1. Equal scores are contacted together, so the curve does
    not depend on row order.
    """
    counts = df.groupBy(col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(col(label).cast("bigint")).alias("hits")
    )
    points = ordered_prefix(counts, "score", ["n", "hits"], descending=True)
    return points.select(
        "score",
        F.col("cum_n").alias("contacted"),
        (F.col("cum_n") / F.col("all_n")).alias("share_contacted"),
        (F.col("cum_hits") / F.greatest(F.col("all_hits"), F.lit(1))).alias("share_captured"),
    )


def tier_counts(df: DataFrame, tier: str) -> DataFrame:
    """Records per risk tier in the order High, Medium, Low; missing tiers count 0."""
    counts = df.groupBy(col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame(list(enumerate(TIER_ORDER, 1)), "position int, tier string")
    return frame.join(counts, "tier", "left").select("position", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def _coded(values: DataFrame, by: Sequence[str] = (), written: bool = False) -> DataFrame:
    """``code`` per row: the place of its unique ``value`` in alphabetical order, from 0 for each of ``by``.

    The values are cut into ranges whose number grows with the values, numbered inside a range, and shifted
    by the sizes of the lower ranges.
    """
    cut = range_slots(values, [*by, "value"], written=written)
    sizes = cut.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_slot", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_slot").orderBy("value")
    place = F.row_number().over(inside) - 1 + F.col("_base")
    return cut.join(broadcast_if_small(sizes), [*by, "_slot"]).withColumn("code", place.cast("double")).drop("_slot", "_base")


def string_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): position of each distinct text in alphabetical order."""
    values = df.select(col(name).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return _coded(values)


def text_correlations(df: DataFrame, texts: Sequence[str], y: Column) -> DataFrame:
    """(column, r): correlation of a number with the alphabetical codes of each text column, null being -1.

    All columns are summed up per value at once, so only distinct values are shuffled and no row is joined.
    The number is taken from its mean first, and the codes from theirs, so that large ones keep their digits.
    """
    wide = df.select(*[col(t).cast("string").alias(t) for t in texts], y.alias("_y"))
    middle = wide.agg(F.avg("_y").alias("m")).first()["m"]
    rows = wide.withColumn("_y", F.col("_y") - F.lit(middle).cast("double")).unpivot("_y", [col(t) for t in texts], "column", "value")
    sums = [F.count("_y").alias("n"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(a) for a, e in (("y", F.col("_y")), ("yy", F.col("_y") * F.col("_y")))]]
    values = materialize(rows.groupBy("column", "value").agg(*sums), "values")
    coded = _coded(values.where("value IS NOT NULL"), ["column"], written=True).unionByName(values.where("value IS NULL").withColumn("code", F.lit(-1.0)))
    coded = materialize(coded.select("column", "code", "n", "y", "yy"), "codes")
    n, code = F.col("n"), F.col("code")
    # One row a column.
    means = F.broadcast(coded.groupBy("column").agg((F.sum(code * n) / F.nullif(F.sum(n), F.lit(0))).alias("mean")))
    off = code - F.col("mean")
    spread = F.sqrt(F.sum(n * off * off) * F.sum("yy"))
    return coded.join(means, "column").groupBy("column").agg(F.when(spread > 0, F.sum(off * F.col("y")) / spread).alias("r"))


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """Correlation of each column with a numeric target; texts enter as alphabetical codes."""
    numbers = numeric_columns(df, [target])
    texts = categorical_columns(df, [target])
    y = as_double(df, target)
    wide = df.agg(*[finite_double(pearson(as_double(df, n), y)).alias(f"r{i}") for i, n in enumerate(numbers)], F.count(F.lit(1)).alias("_n"))
    found = [long_rows(wide, [(n, [F.col(f"r{i}")]) for i, n in enumerate(numbers)], ["r"])] if numbers else []
    if texts:
        found.append(text_correlations(df, texts, y))
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], "column string, r double")


def exploratory_tables(df: DataFrame, target: str | None) -> dict[str, DataFrame]:
    """All chart tables that apply to a table and its target."""
    numbers = numeric_columns(df, [target] if target else [])
    out: dict[str, DataFrame] = {}
    if numbers:
        out["histograms"] = histograms(df, numbers)
    if len(numbers) >= 2:
        out["correlations"] = correlation_matrix(df, target)
    if target:
        out["target"] = target_distribution(df, target)
        if categorical_columns(df, [target]):
            out["category_rates"] = category_rates(df, target)
        if numbers:
            out["boxes"] = box_stats(df, target)
    return out
