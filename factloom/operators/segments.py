"""Quartile labels, driver segments, base rate and top-decile capture."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col, is_numeric
from factloom.operators.order import column_quantiles, ordered_prefix
from factloom.operators.profile import SURELY_MANY, few_valued

# Segment limits.
MAX_LEVELS_AS_IS = 8
MIN_SEGMENT_ROWS, MIN_SEGMENT_SHARE = 30, 0.02
HIGH_LIFT, LOW_LIFT = 1.15, 0.85
QUARTILES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def quartile_label(value: Column, edges: Sequence[float]) -> Column:
    """'a to b' for right-closed bins; the first bin includes the minimum."""
    cuts = sorted(set(edges))
    if len(cuts) < 2:
        return F.lit("nan")
    label = F.when(value.isNull(), F.lit("nan"))
    for low, high in zip(cuts, cuts[1:]):
        label = label.when(value <= F.lit(high), F.lit(f"{low:,.4g} to {high:,.4g}"))
    return label.otherwise(F.lit("nan"))


def _labels(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Segment label per column; quartiles for all many-valued numbers in one pass."""
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    counts = few_valued(df, numeric)
    binned = [n for n in numeric if counts.get(n, SURELY_MANY) > MAX_LEVELS_AS_IS]
    edges = column_quantiles(df, binned, QUARTILES)
    out = {}
    for n in names:
        if n in edges:
            out[n] = quartile_label(as_double(df, n), list(edges[n].values()))
        else:
            out[n] = F.coalesce(col(n).cast("string"), F.lit("nan"))
    return out


def segment_labels(df: DataFrame, name: str) -> Column:
    return _labels(df, [name])[name]


def quartile_segments(df: DataFrame, name: str) -> DataFrame:
    """Rows per quartile label of one numeric column."""
    edges = column_quantiles(df, [name], QUARTILES)[name]
    label = quartile_label(as_double(df, name), list(edges.values()))
    value = as_double(df, name)
    return df.groupBy(label.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def driver_segments(df: DataFrame, importance: Mapping[str, float], outcome: Column) -> DataFrame:
    """(column, segment, n, share, value, lift, importance) for large enough segments.

    ``outcome`` is 0/1 for a rate or a number for a mean. All columns are
    unpivoted and grouped in a single aggregate.
    """
    chosen = [c for c in importance if c in df.columns]
    labels = _labels(df, chosen)
    data = df.select(*[labels[c].alias(c) for c in chosen], outcome.cast("double").alias("_y"))
    totals = data.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y")).first()
    rows, overall = totals["n"], totals["y"]
    floor = max(MIN_SEGMENT_ROWS, int(MIN_SEGMENT_SHARE * rows))
    weight = F.create_map(*[x for c in chosen for x in (F.lit(c), F.lit(float(importance[c])))])
    lift = F.col("value") / F.lit(overall) if overall else F.lit(None).cast("double")
    return (
        data.unpivot(["_y"], [col(c) for c in chosen], "column", "segment")
        .groupBy("column", "segment")
        .agg(F.count("_y").alias("n"), F.avg("_y").alias("value"))
        .filter(F.col("n") >= floor)
        .select(
            "column", "segment", "n",
            (F.col("n") / F.lit(float(max(rows, 1)))).alias("share"),
            "value",
            lift.alias("lift"),
            weight[F.col("column")].alias("importance"),
            F.lit(overall).cast("double").alias("overall"),
        )
    )


def segment_findings(segments: DataFrame) -> DataFrame:
    """Ranked picks: (direction, position, segment columns).

    High: lift above 1.15, largest excess first, six at most and one per
    column. Low: lift under 0.85, two smallest values.
    """
    excess = F.col("n") * (F.col("value") - F.col("overall"))
    high = segments.filter(F.col("lift") > HIGH_LIFT).orderBy(F.desc(excess), "column", "segment").limit(6)
    first = Window.partitionBy("column").orderBy(F.desc(excess), "segment")
    order = Window.partitionBy("direction").orderBy(F.desc(excess), "column", "segment")
    high = (
        high.withColumn("_rn", F.row_number().over(first))
        .filter("_rn = 1")
        .drop("_rn")
        .withColumn("direction", F.lit("high"))
        .withColumn("position", F.row_number().over(order))
    )
    low_order = Window.partitionBy("direction").orderBy("value", "column", "segment")
    low = (
        segments.filter(F.col("lift") < LOW_LIFT)
        .orderBy("value", "column", "segment")
        .limit(2)
        .withColumn("direction", F.lit("low"))
        .withColumn("position", F.row_number().over(low_order))
    )
    return high.unionByName(low)


def top_capture(df: DataFrame, score: str, label: str, share: float = 0.1) -> DataFrame:
    """Base rate, and the share of positives among the top ``share`` of rows by score.

    When the cut falls inside equal scores, their positives count in proportion.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    take = max(1, int(rows * share))
    counts = df.groupBy(col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(col(label).cast("bigint")).alias("hits")
    )
    points = ordered_prefix(counts, "score", ["n", "hits"], descending=True)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(take) - (F.col("cum_n") - F.col("n"))))
    caught = F.sum(F.col("hits") * taken / F.col("n"))
    return points.agg(F.sum("hits").alias("positives"), caught.alias("_caught")).select(
        F.lit(rows).cast("bigint").alias("row_count"),
        "positives",
        (F.col("positives") / F.lit(max(rows, 1))).alias("base_rate"),
        F.lit(take).cast("bigint").alias("top_rows"),
        (F.col("_caught") / F.greatest(F.col("positives"), F.lit(1))).alias("top_capture"),
        (F.col("_caught") / F.greatest(F.col("positives"), F.lit(1)) / F.lit(share)).alias("top_lift"),
    )
