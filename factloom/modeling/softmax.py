"""Boosting for several classes at once: one small tree a class and round, all on the residuals of one softmax."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize, run_jobs

PROBABILITIES = "_softmax"
SMALLEST_SHARE, LARGEST_STEP = 1e-6, 4.0
CUT_ROUNDS = 5


def softmax(scores: Column) -> Column:
    odds = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return F.transform(odds, lambda o: o / total)


@dataclass
class SoftmaxBoosting:
    """Fits ``features``, ``_y`` (0 to classes - 1) and the weight ``_w``.

    A round fits, for each class c, a regression tree to r / h with weight w * h, where r = [y = c] - p
    and h = p (1 - p): its leaf means are the Newton steps sum(w r) / sum(w h). All trees of a round see
    the same p. Scores are written every few rounds, which cuts the lineage.
    """

    classes: int
    rounds: int
    depth: int = 5
    step: float = 0.1
    seed: int = 42

    def fit(self, data: DataFrame) -> PipelineModel:
        starts = self._starts(data)
        current = data.select("features", "_y", "_w").withColumn("_scores", F.array(*[F.lit(s) for s in starts]))
        current = materialize(current, "softmax")
        size = self.step * (self.classes - 1) / self.classes
        trees: list[list[DecisionTreeRegressionModel]] = []
        for done in range(1, self.rounds + 1):
            known = current.withColumn("_p", softmax(F.col("_scores"))).persist()
            grown = run_jobs(data.sparkSession, lambda c: self._tree(known, c), range(self.classes), self.classes)
            known.unpersist()
            trees.append(grown)
            current = self._moved(current, grown, size)
            if done % CUT_ROUNDS == 0:
                current = materialize(current, "softmax")
        members = [_sum_of_trees([g[c] for g in trees], size, f"_score{c}") for c in range(self.classes)]
        return PipelineModel([*members, SQLTransformer(statement=_statement(starts))])

    def _starts(self, data: DataFrame) -> list[float]:
        """Logarithms of the weighted class shares; a class without rows gets a tiny one."""
        found = {int(r["_y"]): r["w"] for r in data.groupBy("_y").agg(F.sum("_w").alias("w")).collect()}
        total = sum(found.values()) or 1.0
        return [log(max(found.get(c, 0.0) / total, SMALLEST_SHARE)) for c in range(self.classes)]

    def _tree(self, known: DataFrame, c: int) -> DecisionTreeRegressionModel:
        p = F.col("_p")[c]
        bend = F.greatest(p * (1 - p), F.lit(SMALLEST_SHARE))
        pull = ((F.col("_y") == c).cast("double") - p) / bend
        limited = F.greatest(F.lit(-LARGEST_STEP), F.least(F.lit(LARGEST_STEP), pull))
        ready = known.select("features", limited.alias("_pull"), (F.col("_w") * bend).alias("_bend"))
        return DecisionTreeRegressor(
            labelCol="_pull", weightCol="_bend", featuresCol="features", maxDepth=self.depth, seed=self.seed
        ).fit(ready)

    def _moved(self, current: DataFrame, grown: Sequence[DecisionTreeRegressionModel], size: float) -> DataFrame:
        out = current
        for c, tree in enumerate(grown):
            out = tree.setPredictionCol(f"_t{c}").transform(out)
        moved = F.array(*[F.col("_scores")[c] + F.lit(size) * F.col(f"_t{c}") for c in range(self.classes)])
        return out.select("features", "_y", "_w", moved.alias("_scores"))


def _sum_of_trees(trees: Sequence[DecisionTreeRegressionModel], size: float, name: str) -> GBTRegressionModel:
    """One weighted sum of trees, so that it is scored in one step and stored by Spark."""
    context = SparkContext._active_spark_context
    package = context._jvm.org.apache.spark.ml.regression
    members = context._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], weights[i] = tree._java_obj, size
    return GBTRegressionModel(package.GBTRegressionModel(f"softmax{name}", members, weights)).setPredictionCol(name)


def _statement(starts: Sequence[float]) -> str:
    names = [f"_score{c}" for c in range(len(starts))]
    scores = ", ".join(f"{n} + CAST({s!r} AS DOUBLE)" for n, s in zip(names, starts))
    odds = f"SELECT *, transform(_all, s -> exp(s - array_max(_all))) AS _odds FROM (SELECT *, array({scores}) AS _all FROM __THIS__)"
    shares = f"transform(_odds, o -> o / aggregate(_odds, 0D, (a, b) -> a + b)) AS {PROBABILITIES}"
    return f"SELECT * EXCEPT ({', '.join(names)}, _all, _odds), {shares} FROM ({odds})"
