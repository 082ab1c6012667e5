"""Columns that give the target away: one rule set warns, the other drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, clean_value, col, fused_agg, is_nested, is_numeric, pearson
from factloom.operators.charts import string_codes
from factloom.operators.groups import crosstab_purity
from factloom.operators.order import average_ranks, column_quantiles

# Warning and dropping limits.
WARN_LIMIT = 0.98
MIN_PAIRS = 10
DROP_CORRELATION, DROP_PURITY, PURITY_GAIN, ROWS_PER_LEVEL = 0.97, 0.985, 0.1, 20
MISSING_LEVEL = "__MISSING__"


def column_auc(df: DataFrame, names: list[str], label: Column) -> DataFrame:
    """Exact AUC of each numeric column against a 0/1 label, nulls at the median; (column, auc)."""
    holes = fused_agg(df, [F.count_if(as_double(df, n).isNull()).alias(f"h{i}") for i, n in enumerate(names)])
    medians = column_quantiles(df, [n for i, n in enumerate(names) if holes[f"h{i}"]], {"median": 0.5})
    filled = df.select(
        label.cast("int").alias("_y"),
        *[
            F.coalesce(as_double(df, n), F.lit(medians.get(n, {}).get("median"))).alias(n)
            for n in names
        ],
    ).filter(F.col("_y").isNotNull())
    long = filled.unpivot(["_y"], [col(n) for n in names], "column", "value")
    ranked = average_ranks(long, "value", ["_y"], ["column"])
    pos = F.col("_y") == 1
    sums = ranked.groupBy("column").agg(
        F.sum(F.when(pos, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(~pos, F.col("n")).otherwise(0)).alias("q"),
        F.sum(F.when(pos, F.col("n") * F.col("rank")).otherwise(0.0)).alias("r"),
    )
    p = F.col("p").cast("double")
    return sums.select("column", ((F.col("r") - p * (p + 1) / 2) / (p * F.col("q"))).alias("auc"))


def category_auc(df: DataFrame, names: list[str], label: Column) -> DataFrame:
    """Best one-against-rest AUC over the levels of each text column; (column, auc)."""
    data = df.select(
        label.cast("int").alias("_y"),
        *[F.coalesce(col(n).cast("string"), F.lit(MISSING_LEVEL)).alias(n) for n in names],
    ).filter(F.col("_y").isNotNull())
    totals = data.agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q")).first()
    levels = (
        data.unpivot(["_y"], [col(n) for n in names], "column", "value")
        .groupBy("column", "value")
        .agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q"))
    )
    auc = (1 + F.col("p") / F.lit(totals["p"]) - F.col("q") / F.lit(totals["q"])) / 2
    return levels.groupBy("column").agg(F.max(F.greatest(auc, 1 - auc)).alias("auc"))


def leakage_measures(df: DataFrame, target: str, classification: bool) -> DataFrame:
    """(column, agreement, correlation, auc) of every feature with the target.

    Agreement compares text with the original label. Correlation and AUC use
    the label's position in text order for two classes.
    """
    features = [f.name for f in df.schema.fields if f.name != target and not is_nested(f.dataType)]
    data = df.filter(clean_value(target, df.schema[target].dataType).isNotNull())
    text = col(target).cast("string")
    binary = False
    if classification:
        ends = data.agg(F.min(text).alias("a"), F.max(text).alias("b")).first()
        binary = ends["a"] != ends["b"] and data.filter(~text.isin(ends["a"], ends["b"])).limit(1).count() == 0
    numeric_target = is_numeric(df.schema[target].dataType)
    y = F.when(text == ends["b"], 1.0).otherwise(0.0) if binary else (
        as_double(df, target) if numeric_target else F.lit(None).cast("double")
    )

    aggs = []
    for i, n in enumerate(features):
        value = clean_value(n, df.schema[n].dataType)
        aggs.append(F.count(value).alias(f"n{i}"))
        aggs.append(F.avg(F.when(value.isNotNull(), (value.cast("string") == text).cast("double"))).alias(f"e{i}"))
        if is_numeric(df.schema[n].dataType):
            x = as_double(df, n)
            aggs.append(F.nanvl(pearson(x, y), F.lit(None).cast("double")).alias(f"r{i}"))
        else:
            aggs.append(F.lit(None).cast("double").alias(f"r{i}"))
    wide = data.agg(*aggs)
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"n{i}").alias("n"),
            F.col(f"e{i}").alias("agreement"),
            F.col(f"r{i}").alias("correlation"),
        )
        for i, n in enumerate(features)
    ]
    base = wide.select(F.inline(F.array(*rows)))
    if not binary:
        return base.withColumn("auc", F.lit(None).cast("double"))
    numeric = [n for n in features if is_numeric(df.schema[n].dataType)]
    texts = [n for n in features if n not in numeric]
    parts = []
    if numeric:
        parts.append(column_auc(data, numeric, y))
    if texts:
        parts.append(category_auc(data, texts, y))
    aucs = reduce(DataFrame.unionByName, parts).select("column", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    return base.join(F.broadcast(aucs), "column", "left")


def leakage_warnings(df: DataFrame, target: str, classification: bool) -> DataFrame:
    """(column, rule, value) for features above a warning limit; an exact copy stops there."""
    found = leakage_measures(df, target, classification).filter(F.col("n") >= MIN_PAIRS)
    copy = F.col("agreement") > WARN_LIMIT
    hits = F.array(
        F.when(copy, F.struct(F.lit("agreement").alias("rule"), F.col("agreement").alias("value"))),
        F.when(
            ~copy & (F.abs("correlation") > WARN_LIMIT),
            F.struct(F.lit("correlation").alias("rule"), F.abs("correlation").alias("value")),
        ),
        F.when(~copy & (F.col("auc") > WARN_LIMIT), F.struct(F.lit("auc").alias("rule"), F.col("auc").alias("value"))),
    )
    return found.select("column", F.explode(F.array_compact(hits)).alias("h")).select("column", "h.rule", "h.value")


def leakage_messages(warnings: DataFrame) -> list[str]:
    texts = {
        "agreement": "Feature '{c}' is a near-duplicate of the target (>0.98 exact agreement). Possible leakage.",
        "correlation": "Feature '{c}' has absolute target correlation {v:.4f} (>0.98). Possible leakage.",
        "auc": "Feature '{c}' has single-feature AUC {v:.4f} (>0.98). Possible leakage.",
    }
    return [texts[r["rule"]].format(c=r["column"], v=r["value"]) for r in warnings.orderBy("column", "rule").collect()]


def leaking_columns(df: DataFrame, target: str, kinds: dict[str, str], problem: str) -> DataFrame:
    """(column, rule, value) of features to drop: name overlap, near-perfect correlation, pure levels."""
    plain = target.lower().replace("_", "")
    named: list[str] = []
    numeric: list[str] = []
    levels: list[str] = []
    for f in df.schema.fields:
        kind = kinds.get(f.name)
        if f.name == target or kind in ("id", "text", "datetime"):
            continue
        other = f.name.lower().replace("_", "")
        if len(plain) >= 4 and (plain in other or other in plain):
            named.append(f.name)
        elif kind == "numeric" and is_numeric(f.dataType):
            numeric.append(f.name)
        elif kind in ("categorical", "boolean") and problem == "classification":
            levels.append(f.name)
    spark = df.sparkSession
    shape = "column string, rule string, value double"
    parts = [spark.createDataFrame([(n, "name", None) for n in named], shape)]
    if numeric:
        if problem == "classification":
            text = F.coalesce(col(target).cast("string"), F.lit("nan"))
            data = df.withColumn("_label", text)
            codes = string_codes(data, "_label").select(F.col("value").alias("_label"), F.col("code").alias("_y"))
            data = data.join(codes, "_label")
        else:
            data = df.withColumn("_y", F.coalesce(as_double(df, target), F.lit(0.0)))
        medians = column_quantiles(df, numeric, {"median": 0.5})
        wide = data.agg(
            *[
                F.nanvl(pearson(F.coalesce(as_double(df, n), F.lit(medians[n]["median"])), F.col("_y")), F.lit(None).cast("double")).alias(f"r{i}")
                for i, n in enumerate(numeric)
                if n in medians
            ]
        )
        rows = [
            F.struct(F.lit(n).alias("column"), F.lit("correlation").alias("rule"), F.col(f"r{i}").alias("value"))
            for i, n in enumerate(numeric)
            if n in medians
        ]
        parts.append(wide.select(F.inline(F.array(*rows))).filter(F.abs("value") > DROP_CORRELATION))
    for n in levels:
        table = crosstab_purity(df, n, target)
        pure = (
            (F.col("levels") > 1)
            & (F.col("row_count") / F.col("levels") >= ROWS_PER_LEVEL)
            & (F.col("purity") > DROP_PURITY)
            & (F.col("purity") - F.col("base_share") > PURITY_GAIN)
        )
        parts.append(
            table.filter(pure).select(
                F.lit(n).alias("column"), F.lit("purity").alias("rule"), F.col("purity").alias("value")
            )
        )
    return reduce(DataFrame.unionByName, parts)
