"""Group statistics, crosstabs, cohorts and key figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col, long_values
from factloom.operators.order import exact_quantiles


def group_stats(df: DataFrame, group: str, metric: str) -> DataFrame:
    """n, mean, median and std of a metric per group; rows lacking either are left out."""
    data = df.select(col(group).cast("string").alias("group"), as_double(df, metric).alias("metric")).filter(
        F.col("group").isNotNull() & F.col("metric").isNotNull()
    )
    moments = data.groupBy("group").agg(
        F.count("metric").alias("n"),
        F.avg("metric").alias("mean"),
        F.coalesce(F.stddev_samp("metric"), F.lit(0.0)).alias("std"),
    )
    medians = exact_quantiles(data, ["metric"], {"median": 0.5}, by=["group"]).select("group", "median")
    return moments.join(medians, "group").select("group", "n", "mean", "median", "std")


def quantiles(df: DataFrame, names: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    return exact_quantiles(df, names, probs)


def crosstab_purity(df: DataFrame, left: str, right: str) -> DataFrame:
    """Share of rows that fall in the most frequent right value of their left value."""
    cells = df.groupBy(
        F.coalesce(col(left).cast("string"), F.lit("nan")).alias("a"),
        F.coalesce(col(right).cast("string"), F.lit("nan")).alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))
    levels = cells.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    base = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.max("n")).scalar()
    return levels.agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("row_count"), F.sum("best").alias("best")
    ).select(
        "levels",
        "row_count",
        (F.col("best") / F.col("row_count")).alias("purity"),
        (base / F.col("row_count")).alias("base_share"),
    )


def cohort_union(first: DataFrame, second: DataFrame, label: str = "_ab_group") -> DataFrame:
    """Two cohorts stacked under the fixed labels of a two-table comparison."""
    return first.withColumn(label, F.lit("Control (A)")).unionByName(
        second.withColumn(label, F.lit("Treatment (B)")), allowMissingColumns=True
    )


def cohort_rates(df: DataFrame, cohorts: Mapping[str, Column], outcome: Column) -> DataFrame:
    """Outcome rate in percent per cohort value, for several cohort definitions in one job."""
    data = df.select(*[c.cast("string").alias(n) for n, c in cohorts.items()], outcome.cast("double").alias("_y"))
    return (
        long_values(data, list(cohorts), "string", ["_y"])
        .groupBy(F.col("column").alias("cohort"), "value")
        .agg((F.avg("_y") * 100).alias("rate"), F.count(F.lit(1)).alias("n"))
    )


def kpi_block(df: DataFrame, churned: Column, at_risk: Column, revenue: str, tenure: str) -> DataFrame:
    """Totals, churn rate, revenue at risk and mean tenure by class, in one aggregate."""
    amount = col(revenue).cast("decimal(38,2)")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(churned).alias("churned"),
        (F.avg(churned.cast("double")) * 100).alias("churn_rate"),
        F.count_if(at_risk).alias("at_risk"),
        F.sum(amount).cast("double").alias("revenue"),
        F.coalesce(F.sum(F.when(at_risk, amount)), F.lit(0)).cast("double").alias("revenue_at_risk"),
        F.avg(F.when(churned, col(tenure))).alias("avg_tenure_churned"),
        F.avg(F.when(~churned, col(tenure))).alias("avg_tenure_stayed"),
    )


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def importance_tail(importance: DataFrame, k: int = 12) -> DataFrame:
    """The k largest weights, shown in ascending order."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k).orderBy("importance", "feature")
