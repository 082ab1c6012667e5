"""Segmentation: feature matrix, k-means, traits of each segment, and their places on two axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col, fused_agg, long_values
from factloom.operators.order import column_quantiles
from factloom.operators.profile import few_valued, modes, value_counts
from factloom.session import deal, materialize, run_jobs

# Limits of the segmentation.
MAX_LEVELS, RARE_SHARE, RARE_LEVEL = 15, 0.02, "__RARE__"
MIN_ROWS, MAX_K = 50, 6
TRAITS = 3
# Fits at once: each holds the vectors of all rows.
PARALLEL_FITS = 2


def usable_categories(df: DataFrame, names: Sequence[str]) -> list[str]:
    counts = few_valued(df, names)
    return [n for n in names if counts.get(n, MAX_LEVELS + 1) <= MAX_LEVELS]


def feature_matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Adds ``features``: medians filled and standardised numbers, one-hot levels with rare ones pooled."""
    medians = column_quantiles(df, numeric, {"median": 0.5})
    common = modes(df, categorical)
    frequent: dict[str, list[str]] = {}
    if categorical:
        for r in value_counts(df, categorical).filter(F.col("share") >= RARE_SHARE).collect():
            frequent.setdefault(r["column"], []).append(r["value"])
    ready = df
    for n in numeric:
        ready = ready.withColumn(
            f"_n_{n}", F.coalesce(as_double(df, n), F.lit(medians.get(n, {}).get("median", 0.0)))
        )
    for n in categorical:
        value = F.coalesce(col(n).cast("string"), F.lit(common.get(n, RARE_LEVEL)))
        ready = ready.withColumn(
            f"_c_{n}", F.when(value.isin(frequent.get(n, [])), value).otherwise(RARE_LEVEL)
        )
    stages: list = []
    parts: list[str] = []
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"_n_{n}" for n in numeric], outputCol="_numbers"))
        stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
        parts.append("_scaled")
    if categorical:
        indexed, encoded = [f"_i_{n}" for n in categorical], [f"_o_{n}" for n in categorical]
        stages.append(
            StringIndexer(
                inputCols=[f"_c_{n}" for n in categorical], outputCols=indexed, stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False))
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages).fit(ready).transform(ready).select(*[col(c) for c in df.columns], "features")


def segmentation(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_k: int = MAX_K
) -> tuple[DataFrame, dict[str, object]] | None:
    """(table with ``segment`` and ``features``, facts); None when there is too little to group."""
    categorical = usable_categories(df, categorical)
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if rows < MIN_ROWS or not (numeric or categorical):
        return None
    data = materialize(deal(feature_matrix(df, numeric, categorical), rows), "matrix")
    # Read from files: k-means then holds its vectors as objects, while of a persisted table every pass unpacks them again.
    points = data.select("features")
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="segment")

    def judged(k: int) -> tuple[float, KMeansModel]:
        model = KMeans(k=k, seed=0, featuresCol="features", predictionCol="segment").fit(points)
        labelled = model.transform(points)
        return (judge.evaluate(labelled) if labelled.select("segment").distinct().count() > 1 else -1.0), model

    tried = list(range(2, max_k + 1))
    found = run_jobs(df.sparkSession, judged, tried, PARALLEL_FITS)
    scores = [score for score, _ in found]
    best_score = max(scores)
    best = scores.index(best_score)
    return found[best][1].transform(data), {"k": tried[best], "silhouette": round(best_score, 3), "rows": rows}


def segment_traits(
    df: DataFrame, segment: str, numeric: Sequence[str], categorical: Sequence[str], keep: int = TRAITS
) -> DataFrame:
    """The most telling traits per segment: standardised mean shifts and three times share gains."""
    parts = []
    data = df.select(
        col(segment).cast("string").alias("_seg"),
        *[as_double(df, n).alias(n) for n in numeric],
        *[F.coalesce(col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical],
    )
    if numeric:
        overall = fused_agg(
            data,
            [a for i, n in enumerate(numeric) for a in (F.avg(n).alias(f"m{i}"), F.stddev_samp(n).alias(f"s{i}"))],
        )
        means = data.unpivot(["_seg"], [col(n) for n in numeric], "column", "value").groupBy("_seg", "column").agg(
            F.avg("value").alias("mean")
        )
        base = F.create_map(*[x for i, n in enumerate(numeric) for x in (F.lit(n), F.lit(overall[f"m{i}"]).cast("double"))])
        spread = F.create_map(*[x for i, n in enumerate(numeric) for x in (F.lit(n), F.lit(overall[f"s{i}"] or 1.0).cast("double"))])
        z = (F.col("mean") - base[F.col("column")]) / spread[F.col("column")]
        parts.append(
            means.select(
                "_seg", "column",
                F.abs(z).alias("strength"),
                F.concat(
                    "column", F.lit(" "), F.when(z > 0, "higher").otherwise("lower"), F.lit(" than average ("),
                    F.format_number("mean", 2), F.lit(" vs "), F.format_number(base[F.col("column")], 2), F.lit(")"),
                ).alias("trait"),
            )
        )
    if categorical:
        cells = long_values(data, categorical, "string", ["_seg"]).groupBy("_seg", "column", "value").agg(
            F.count(F.lit(1)).alias("n")
        )
        within = Window.partitionBy("_seg", "column")
        across = Window.partitionBy("column")
        level = Window.partitionBy("column", "value")
        first = within.orderBy(F.desc("n"), "value")
        top = (
            cells.withColumn("share", F.col("n") / F.sum("n").over(within))
            .withColumn("base", F.sum("n").over(level) / F.sum("n").over(across))
            .withColumn("_rn", F.row_number().over(first))
            .filter("_rn = 1")
        )
        parts.append(
            top.select(
                "_seg", "column",
                (F.abs(F.col("share") - F.col("base")) * 3).alias("strength"),
                F.format_string(
                    "%s = %s (%s%% vs %s%% overall)", "column", "value",
                    F.bround(F.col("share") * 100, 0).cast("int"), F.bround(F.col("base") * 100, 0).cast("int"),
                ).alias("trait"),
            )
        )
    traits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = Window.partitionBy("_seg").orderBy(F.desc("strength"), F.desc("trait"))
    sizes = data.groupBy("_seg").agg(F.count(F.lit(1)).alias("size"))
    total = data.agg(F.count(F.lit(1))).scalar()
    return (
        traits.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= keep)
        .join(sizes, "_seg")
        .select(
            F.col("_seg").alias("segment"), "size", F.round(F.col("size") / total, 3).alias("share"),
            "position", "column", "strength", "trait",
        )
    )


def segment_scatter(segmented: DataFrame) -> DataFrame:
    """Two centred principal axes for every row: (x, y, segment)."""
    centred = StandardScaler(inputCol="features", outputCol="_centred", withMean=True, withStd=False)
    axes = Pipeline(stages=[centred, PCA(k=2, inputCol="_centred", outputCol="_axes")]).fit(segmented)
    xy = vector_to_array("_axes")
    return axes.transform(segmented).select(F.round(xy[0], 3).alias("x"), F.round(xy[1], 3).alias("y"), "segment")
