"""Attributions: exact for linear models, along the decision path for trees."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import col
from factloom.modeling.prep import SEED, hash_ranks, label_column, spread
from factloom.modeling.scoring import FittedModel, part_output
from factloom.modeling.tournament import choose_metric, fold_scores
from factloom.session import materialize, scratch_path

TOP_DRIVERS, TOP_REASONS = 10, 3


def _coefficients(model: Model) -> list[float] | None:
    if hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        return [float(v) for v in (matrix[0] if len(matrix) == 1 else matrix[1])]
    if hasattr(model, "coefficients"):
        return [float(v) for v in model.coefficients.toArray()]
    return None


def tree_nodes(model: Model) -> list[dict[str, np.ndarray]]:
    """Node arrays per tree of a Spark tree model, read from its saved form.

    Value is the share of class 1, or the prediction for regression trees;
    boosted trees carry their weight.
    """
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    pdf = data.orderBy("treeID", "id").toPandas()
    classify = "Classif" in type(model).__name__ and not boosted
    trees = []
    for tree, part in pdf.groupby("treeID"):
        size = int(part["id"].max()) + 1
        out = {
            "feature": np.full(size, -1), "left": np.zeros(size, dtype=int), "right": np.zeros(size, dtype=int),
            "cut": np.zeros(size), "value": np.zeros(size), "zero_left": np.zeros(size, dtype=bool),
            "categorical": np.zeros(size, dtype=bool),
        }
        scale = weights[int(tree)] if boosted else 1.0 / max(len(weights), 1)
        for row in part.itertuples():
            i = int(row.id)
            stats = list(row.impurityStats)
            if classify:
                value = stats[1] / max(sum(stats), 1e-12) if len(stats) == 2 else row.prediction
            else:
                value = stats[1] / max(stats[0], 1e-12) if len(stats) == 3 else row.prediction
            out["value"][i] = value * scale
            if row.leftChild >= 0:
                split = row.split
                out["feature"][i] = split["featureIndex"]
                out["left"][i], out["right"][i] = row.leftChild, row.rightChild
                if split["numCategories"] < 0:
                    out["cut"][i] = split["leftCategoriesOrThreshold"][0]
                else:
                    out["categorical"][i] = True
                    out["zero_left"][i] = 0.0 in list(split["leftCategoriesOrThreshold"])
        trees.append(out)
    return trees


def _path_contributions(values: np.ndarray, trees: Sequence[Mapping[str, np.ndarray]]) -> np.ndarray:
    total = np.zeros(values.shape)
    index = np.arange(len(values))
    for tree in trees:
        at = np.zeros(len(values), dtype=int)
        while True:
            feature = tree["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            x = values[index, np.maximum(feature, 0)]
            left = np.where(tree["categorical"][at], (x == 0.0) == tree["zero_left"][at], x <= tree["cut"][at])
            nxt = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
            step = tree["value"][nxt] - tree["value"][at]
            np.add.at(total, (index[inner], feature[inner]), step[inner])
            at = nxt
    return total


def with_contributions(model: FittedModel, df: DataFrame) -> tuple[DataFrame, str]:
    """Adds ``_contrib`` (array, one entry per model feature); the text says how it was made.

    The members of an ensemble weigh the same: each adds its part divided by their number.
    """
    part = model.raw
    ready = part.prep.transform(df).select(*[col(c) for c in df.columns], "features")
    linear = [c for c in (_coefficients(m) for _, m in part.members) if c is not None]
    slopes = None
    if linear:
        mean = np.sum(np.array(linear, dtype=float), axis=0) / len(part.members)
        pairs = F.arrays_zip(
            vector_to_array("features").alias("x"),
            F.array(*[F.lit(float(v)) for v in mean]).alias("c"),
            F.array(*[F.lit(float(v)) for v in model.plan.feature_means]).alias("m"),
        )
        slopes = F.transform(pairs, lambda p: p["c"] * (p["x"] - p["m"]))
    if len(linear) == len(part.members):
        return ready.withColumn("_contrib", slopes), "linear attribution"
    members = [m for _, m in part.members if _coefficients(m) is None]
    trees: list = []
    for m in members:
        for inner in getattr(m, "stages", [m]):
            if hasattr(inner, "trees") or hasattr(inner, "numNodes"):
                trees += tree_nodes(inner)
    shared = df.sparkSession.sparkContext.broadcast((trees, float(len(part.members))))

    @F.pandas_udf("array<double>")
    def contributions(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nodes, count = shared.value
        for cells in parts:
            values = np.vstack(cells.to_numpy()) if len(cells) else np.zeros((0, 0))
            yield pd.Series(list(_path_contributions(values, nodes) / count))

    ready = ready.withColumn("_contrib", contributions(vector_to_array("features")))
    if slopes is None:
        return ready, "decision path attribution, not SHAP"
    return ready.withColumn("_contrib", F.zip_with("_contrib", slopes, lambda a, b: a + b)), "decision path and linear attribution, not SHAP"


def shuffled(data: DataFrame, names: Sequence[str], rows: int, seed: int = SEED) -> DataFrame:
    """``data`` with ``_other``: the ``names`` of another row. Each row is another's exactly once.

    Two orders by hash of ``_place`` number the rows; rows with the same number in both are joined.
    """
    one = hash_ranks(data, rows, None, seed)
    two = hash_ranks(data, rows, None, seed + 1).select("_rank", F.struct(*[col(n) for n in names]).alias("_other"))
    return one.join(two, "_rank").drop("_rank")


def permutation_drivers(model: FittedModel, df: DataFrame, seed: int = SEED) -> DataFrame:
    """(column, score, shuffled_score, importance): what the model's score loses when a column is shuffled over all rows.

    A cross-check of the attributions that holds for any model. All rows are scored once for each column,
    in one pass; a column that the model does not use loses exactly nothing.
    """
    plan = model.plan
    known = df.select(*[col(f) for f in plan.features], label_column(df, plan).alias("_y")).filter(F.col("_y").isNotNull())
    placed = materialize(known.withColumn("_place", F.monotonically_increasing_id()), "permuted")
    rows = placed.count()
    # The ranking leaves a task for each bucket of its hashes, too few to score every row once a column.
    data = materialize(spread(shuffled(placed, plan.features, rows, seed), rows).withColumn("_fold", F.lit(0)), "permuted")
    kept = ["_y", "_fold"]
    held = part_output(model.raw, data, plan, "_s").select(*data.columns, "_s")
    slots = {}
    for i, name in enumerate(plan.features):
        slots[f"_s{i}"] = name
        own = [F.col("_other").getField(name).alias(name) if c == name else col(c) for c in held.columns]
        back = held.select(*own, col(name).alias("_own"))
        scored = part_output(model.raw, back, plan, f"_s{i}")
        held = scored.select(*[F.col("_own").alias(name) if c == name else col(c) for c in scored.columns if c != "_own"])
    wide = materialize(held.select(*kept, "_s", *slots), "permuted")
    scores = fold_scores(wide, ["_s", *slots], plan, choose_metric(plan))
    found = {r["candidate"]: r["score"] for r in scores.collect()}  # one row per column
    rows_ = [(name, found["_s"], found[slot], found["_s"] - found[slot]) for slot, name in slots.items()]
    return df.sparkSession.createDataFrame(rows_, "column string, score double, shuffled_score double, importance double")


def global_drivers(model: FittedModel, df: DataFrame, top: int = TOP_DRIVERS) -> DataFrame:
    """(feature, weight): mean absolute contribution over all rows, the largest first."""
    scored, _ = with_contributions(model, df)
    names = F.array(*[F.lit(n) for n in model.plan.feature_names])
    return (
        scored.select(F.posexplode("_contrib"))
        .groupBy("pos")
        .agg(F.avg(F.abs("col")).alias("weight"))
        .select(names[F.col("pos")].alias("feature"), F.round("weight", 4).alias("weight"))
        .orderBy(F.desc("weight"), "feature")
        .limit(top)
    )


def top_entries(values: Column, names: Sequence[str], k: int = TOP_REASONS) -> Column:
    """The k entries of largest size as structs (size, name, value)."""
    cells = F.transform(
        F.arrays_zip(values.alias("v"), F.array(*[F.lit(n) for n in names]).alias("n")),
        lambda c: F.struct(F.abs(c["v"]).alias("size"), c["n"].alias("name"), c["v"].alias("value")),
    )
    return F.slice(F.sort_array(cells, asc=False), 1, k)


def row_reasons(model: FittedModel, df: DataFrame, k: int = TOP_REASONS) -> DataFrame:
    """Adds ``reasons``: the k strongest contributions of each row as text."""
    scored, _ = with_contributions(model, df)
    shown = F.create_map(
        *[x for n in df.columns for x in (F.lit(n), F.coalesce(col(n).cast("string"), F.lit("N/A")))]
    )
    reasons = F.transform(
        top_entries(F.col("_contrib"), model.plan.feature_names, k),
        lambda r: F.concat(
            r["name"], F.lit(" = "), F.coalesce(shown[r["name"]], F.lit("N/A")), F.lit(" ("),
            F.when(r["value"] >= 0, "+").otherwise(""), F.format_string("%.3f", r["value"]), F.lit(" impact)"),
        ),
    )
    return scored.withColumn("reasons", reasons).drop("_contrib", "features")


def importance_reasons(df: DataFrame, importance: Mapping[str, float], k: int = TOP_REASONS) -> DataFrame:
    """Fallback reasons from global weights, or from the first columns when there are none."""
    if importance:
        best = sorted(importance.items(), key=lambda nv: -abs(nv[1]))[:k]
        lines = [
            F.concat(
                F.lit(f"{n} = "),
                F.coalesce(col(n).cast("string"), F.lit("N/A")) if n in df.columns else F.lit("N/A"),
                F.lit(f" (key driver, importance weight {w:.3f})"),
            )
            for n, w in best
        ]
    else:
        lines = [
            F.concat(F.lit(f"{n} = "), F.coalesce(col(n).cast("string"), F.lit("N/A")), F.lit(" (primary input feature)"))
            for n in df.columns[:k]
        ]
    return df.withColumn("reasons", F.array(*lines))
