"""Exact model metrics as aggregates: ranking, confusion, cost thresholds, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import col
from factloom.operators.order import ordered_prefix

# Costs and threshold grids.
MISS_COST, FALSE_ALARM_COST, SAVED_SHARE = 500, 50, 0.3
THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
LEGACY_THRESHOLDS = THRESHOLDS[:16]


def rank_metrics(scored: DataFrame, score: str, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows, positives, exact ROC-AUC and step-wise average precision."""
    counts = scored.groupBy(*by, col(score).cast("double").alias("_score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("bigint")).alias("hits")
    )
    points = ordered_prefix(counts, "_score", ["n", "hits"], by, descending=True)
    misses = F.col("n") - F.col("hits")
    above = F.col("cum_hits") - F.col("hits") / F.lit(2.0)
    return points.groupBy(*by).agg(
        F.max("all_n").alias("row_count"),
        F.max("all_hits").alias("positives"),
        F.sum(misses * above).alias("_pairs"),
        F.sum(F.col("hits") * F.col("cum_hits") / F.col("cum_n")).alias("_precision"),
    ).select(
        *by, "row_count", "positives",
        (F.col("_pairs") / F.nullif(F.col("positives") * (F.col("row_count") - F.col("positives")), F.lit(0))).alias("auc"),
        (F.col("_precision") / F.nullif(F.col("positives"), F.lit(0))).alias("average_precision"),
    )


def roc_points(scored: DataFrame, score: str, hit: Column) -> DataFrame:
    """(threshold, true_positive_rate, false_positive_rate) per distinct score."""
    counts = scored.groupBy(col(score).cast("double").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("bigint")).alias("hits")
    )
    points = ordered_prefix(counts, "threshold", ["n", "hits"], descending=True)
    return points.select(
        "threshold",
        (F.col("cum_hits") / F.col("all_hits")).alias("true_positive_rate"),
        ((F.col("cum_n") - F.col("cum_hits")) / (F.col("all_n") - F.col("all_hits"))).alias("false_positive_rate"),
    )


def confusion(scored: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    return scored.groupBy(actual.cast("string").alias("actual"), predicted.cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts; 0 where undefined."""
    truth = cells.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"),
        F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("hits"),
    )
    called = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    both = truth.join(called, "class", "full_outer").na.fill(0)
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("called"), F.lit(0)), zero)
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), zero)
    out = both.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    both_rates = F.nullif(F.col("precision") + F.col("recall"), zero)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / both_rates, zero)
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")


def accuracy(cells: DataFrame) -> DataFrame:
    hits = F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0))
    return cells.agg(F.sum("n").alias("row_count"), (hits / F.sum("n")).alias("accuracy"))


def threshold_table(scored: DataFrame, probability: str, hit: Column, grid: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Per threshold: counts, recall, precision, F1, cost and savings, from one aggregate."""
    p, y = col(probability), hit.cast("boolean")
    aggs = [F.count_if(y).alias("_pos")]
    for i, t in enumerate(grid):
        aggs += [F.count_if(y & (p >= t)).alias(f"_tp{i}"), F.count_if(~y & (p >= t)).alias(f"_fp{i}")]
    wide = scored.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"_tp{i}").alias("tp"),
                F.col(f"_fp{i}").alias("fp"),
                (F.col("_pos") - F.col(f"_tp{i}")).alias("fn"),
            )
            for i, t in enumerate(grid)
        ]
    )
    zero = F.lit(0.0)
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), zero)
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), zero)
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), zero)
    return wide.select(F.inline(rows)).select(
        "threshold", "tp", "fp", "fn",
        recall.alias("recall"), precision.alias("precision"), f1.alias("f1"),
        (F.col("fn") * MISS_COST + F.col("fp") * FALSE_ALARM_COST).alias("cost"),
        (F.col("tp") * MISS_COST * SAVED_SHARE).alias("saved"),
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """The cheapest threshold; the lowest one on ties."""
    return table.orderBy("cost", "threshold").limit(1)


def brier(scored: DataFrame, probability: str, hit: Column) -> DataFrame:
    gap = col(probability) - hit.cast("double")
    return scored.agg(F.count(F.lit(1)).alias("row_count"), F.avg(gap * gap).alias("brier"))


def regression_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2 and MAE per group: the total sum of squares comes from the variance."""
    gap = col(actual) - col(predicted)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop(col(actual)) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(gap)).alias("mae"),
    )


def metric_choice(df: DataFrame, target: str) -> DataFrame:
    """PR-AUC when the smallest class is under a fifth of the rows, else ROC-AUC."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.min("n") / F.sum("n")
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        share.alias("minority_share"),
        F.min_by("value", F.struct("n", "value")).alias("minority_class"),
    ).withColumn("metric", F.when(F.col("minority_share") < 0.20, "PR-AUC").otherwise("ROC-AUC"))
