"""Candidates, cross-validation on shared folds, ensemble, calibration, holdout and model card."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.modeling import metrics as M
from factloom.modeling.prep import (
    MINORITY_LIMIT,
    FeaturePlan,
    fold_count,
    plan_features,
    prep_pipeline,
    training_table,
)
from factloom.modeling.softmax import PROBABILITIES, SoftmaxBoosting
from factloom.session import materialize, run_jobs

# Sizes of the candidates and limits of the verdict.
SEED = 42
TREES, LEAF_ROWS, TREE_DEPTH, FOREST_DEPTH = 50, 2, 4, 10
BOOST_ROUNDS, SHALLOW_ROUNDS, SHALLOW_DEPTH, SHALLOW_STEP = 60, 40, 4, 0.08
ENSEMBLE_SIZE = 3
STRONG_MARGIN, MODERATE_MARGIN = 0.15, 0.10
PARALLEL_FITS = 4
# A deep forest asks every row for its node in every tree at each level. Kept with the row, the node is moved on by one step instead of sought
# from the root again: the same trees. Ten levels of lineage need no checkpoint.
KEPT_NODES = {"cacheNodeIds": True, "checkpointInterval": -1}

CLASSIFIERS = (
    "Logistic Regression",
    "Decision Tree",
    "Gradient Boosting",
    "Random Forest",
    "Random Forest (no bootstrap)",
    "Gradient Boosting (shallow)",
)
REGRESSORS = (
    "Ridge",
    "ElasticNet",
    "Lasso",
    "Decision Tree",
    "Gradient Boosting",
    "Random Forest",
    "Random Forest (no bootstrap)",
    "Gradient Boosting (shallow)",
)


def _linear(alpha: float, l1_share: float, rows: int, label_std: float) -> LinearRegression:
    """Penalties on the scale of the label: Spark divides both by the label deviation."""
    l1 = alpha * l1_share
    l2 = alpha * (1 - l1_share) * (label_std or 1.0)
    if l1_share == 0:
        l2 = alpha / rows * (label_std or 1.0)
    total = l1 + l2
    return LinearRegression(
        labelCol="_y", featuresCol="features", regParam=total, elasticNetParam=l1 / total,
        standardization=False, maxIter=1000, tol=1e-8,
    )


def candidate(name: str, plan: FeaturePlan, label_std: float = 1.0):
    """A fresh estimator by name."""
    if plan.problem == "regression":
        common = {"labelCol": "_y", "featuresCol": "features"}
        return {
            "Ridge": lambda: _linear(1.0, 0.0, plan.rows, label_std),
            "ElasticNet": lambda: _linear(1.0, 0.5, plan.rows, label_std),
            "Lasso": lambda: _linear(1.0, 1.0, plan.rows, label_std),
            "Decision Tree": lambda: DecisionTreeRegressor(maxDepth=TREE_DEPTH, seed=SEED, **common),
            "Gradient Boosting": lambda: GBTRegressor(maxIter=BOOST_ROUNDS, seed=SEED, **common),
            "Random Forest": lambda: RandomForestRegressor(
                numTrees=TREES, minInstancesPerNode=LEAF_ROWS, maxDepth=FOREST_DEPTH, featureSubsetStrategy="all", seed=SEED, **KEPT_NODES, **common
            ),
            "Random Forest (no bootstrap)": lambda: RandomForestRegressor(
                numTrees=TREES, minInstancesPerNode=LEAF_ROWS, maxDepth=FOREST_DEPTH, bootstrap=False,
                featureSubsetStrategy="onethird", seed=SEED, **KEPT_NODES, **common
            ),
            "Gradient Boosting (shallow)": lambda: GBTRegressor(
                maxIter=SHALLOW_ROUNDS, maxDepth=SHALLOW_DEPTH, stepSize=SHALLOW_STEP, seed=SEED, **common
            ),
        }[name]()
    common = {"labelCol": "_y", "featuresCol": "features", "weightCol": "_w"}

    def boosted(**size):
        if len(plan.classes) == 2:
            names = {"rounds": "maxIter", "depth": "maxDepth", "step": "stepSize"}
            return GBTClassifier(seed=SEED, **{names[k]: v for k, v in size.items()}, **common)
        return SoftmaxBoosting(len(plan.classes), **size)

    return {
        "Logistic Regression": lambda: LogisticRegression(
            maxIter=800, regParam=1.0 / plan.rows, standardization=False, **common
        ),
        "Decision Tree": lambda: DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **common),
        "Gradient Boosting": lambda: boosted(rounds=BOOST_ROUNDS),
        "Random Forest": lambda: RandomForestClassifier(
            numTrees=TREES, minInstancesPerNode=LEAF_ROWS, maxDepth=FOREST_DEPTH, seed=SEED, **KEPT_NODES, **common
        ),
        "Random Forest (no bootstrap)": lambda: RandomForestClassifier(
            numTrees=TREES, minInstancesPerNode=LEAF_ROWS, maxDepth=FOREST_DEPTH, bootstrap=False,
            featureSubsetStrategy="sqrt", seed=SEED, **KEPT_NODES, **common
        ),
        "Gradient Boosting (shallow)": lambda: boosted(
            rounds=SHALLOW_ROUNDS, depth=SHALLOW_DEPTH, step=SHALLOW_STEP
        ),
    }[name]()


def class_scores(model: Model, data: DataFrame, classes: int) -> DataFrame:
    """Adds ``_p``: class probabilities as an array, for any of the candidates."""
    scored = model.transform(data)
    if PROBABILITIES in scored.columns:
        return scored.withColumnRenamed(PROBABILITIES, "_p")
    out = scored.withColumn("_p", vector_to_array("probability"))
    return out.drop("rawPrediction", "probability", "prediction")


def predict_with(model: Model, data: DataFrame, plan: FeaturePlan, name: str) -> DataFrame:
    if plan.problem == "regression":
        return model.transform(data).withColumnRenamed("prediction", name)
    return class_scores(model, data, len(plan.classes)).withColumnRenamed("_p", name)


@dataclass
class Tournament:
    plan: FeaturePlan
    metric: str
    table: DataFrame
    out_of_fold: DataFrame
    names: dict[str, str]
    scores: dict[str, dict[str, object]]
    winner: str
    members: list[str]
    notes: list[str] = field(default_factory=list)

    @property
    def baseline(self) -> float:
        return self.scores["Baseline"]["mean"]

    def leaderboard(self) -> DataFrame:
        rows = [
            (name, s.get("mean"), s.get("std"), s.get("error"), name == self.winner)
            for name, s in self.scores.items()
        ]
        return self.table.sparkSession.createDataFrame(
            rows, "candidate string, mean double, std double, error string, winner boolean"
        )


def choose_metric(plan: FeaturePlan) -> str:
    if plan.problem == "regression":
        return "R2"
    return "PR-AUC" if min(plan.class_counts) / sum(plan.class_counts) < MINORITY_LIMIT else "ROC-AUC"


def _baseline_column(train: DataFrame, plan: FeaturePlan):
    if plan.problem == "regression":
        return F.lit(train.agg(F.avg("_y").alias("m")).first()["m"])
    counts = {int(r["_y"]): r["count"] for r in train.groupBy("_y").count().collect()}
    total = sum(counts.values())
    return F.array(*[F.lit(counts.get(i, 0) / total) for i in range(len(plan.classes))])


def out_of_fold(table: DataFrame, plan: FeaturePlan, names: Sequence[str], parallel: int = PARALLEL_FITS):
    """One wide table: fold, label and each candidate's prediction for the rows it did not see."""
    slots = {name: f"c{i}" for i, name in enumerate(names)}
    std = 1.0
    if plan.problem == "regression":
        std = table.agg(F.stddev_pop("_y").alias("s")).first()["s"] or 1.0
    spark = table.sparkSession
    errors: dict[str, str] = {}

    def hold_out(fold: int) -> DataFrame:
        train = table.filter(F.col("_fold") != fold)
        prep = prep_pipeline(plan).fit(train)
        ready = prep.transform(train).select("features", "_y", "_w").persist()
        try:
            base = _baseline_column(ready, plan)

            def fit(name: str):
                try:
                    return candidate(name, plan, std).fit(ready)
                except Exception as exc:  # a failed candidate is recorded, the others go on
                    errors[name] = str(exc).splitlines()[0]
                    return None

            models = run_jobs(spark, fit, names, parallel)
        finally:
            ready.unpersist()
        held = prep.transform(table.filter(F.col("_fold") == fold)).select("features", "_y", "_fold", "_w")
        held = held.withColumn("base", base)
        for name, model in zip(names, models):
            if model is not None:
                held = predict_with(model, held, plan, slots[name])
            else:
                kind = "double" if plan.problem == "regression" else "array<double>"
                held = held.withColumn(slots[name], F.lit(None).cast(kind))
        return materialize(held.select("_y", "_fold", "base", *slots.values()), "held")

    parts = run_jobs(spark, hold_out, range(fold_count(plan)), parallel)
    return reduce(DataFrame.unionByName, parts), slots, errors


def fold_scores(held: DataFrame, columns: Sequence[str], plan: FeaturePlan, metric: str) -> DataFrame:
    """(candidate, fold, score) for all candidates from one pass over the held-out predictions."""
    if plan.problem == "regression":
        long = held.unpivot(["_y", "_fold"], list(columns), "candidate", "pred").filter(F.col("pred").isNotNull())
        return M.regression_metrics(long, "_y", "pred", ["candidate", "_fold"]).select(
            "candidate", "_fold", F.col("r2").alias("score")
        )
    long = held.unpivot(["_y", "_fold"], list(columns), "candidate", "p").filter(F.col("p").isNotNull())
    wanted = range(len(plan.classes))
    if len(plan.classes) == 2:
        rare = min(wanted, key=lambda i: (plan.class_counts[i], i))
        wanted = [rare if metric == "PR-AUC" else 1]
    classes = F.array(*[F.struct(F.lit(float(i)).alias("k"), F.col("p")[i].alias("s")) for i in wanted])
    cells = long.select("candidate", "_fold", "_y", F.explode(classes).alias("c")).select(
        "candidate", "_fold", F.col("c.k").alias("_class"), F.col("c.s").alias("_s"), (F.col("_y") == F.col("c.k")).alias("_hit")
    )
    ranked = M.rank_metrics(cells, "_s", F.col("_hit"), ["candidate", "_fold", "_class"])
    if metric == "PR-AUC":
        score = F.avg(F.coalesce("average_precision", F.lit(0.0)))
    else:
        score = F.sum(F.col("auc") * F.col("positives")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("positives")))
    return ranked.groupBy("candidate", "_fold").agg(score.alias("score"))


def _summaries(scores: DataFrame) -> dict[str, tuple[float, float]]:
    rows = scores.groupBy("candidate").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()
    return {r["candidate"]: (r["m"], r["s"] or 0.0) for r in rows if r["m"] is not None}


def run_tournament(df: DataFrame, target: str, candidates: Sequence[str] | None = None, max_levels: int | None = None) -> Tournament:
    """Score all candidates, the baseline and the top-3 ensemble on the same folds."""
    plan = plan_features(df, target, max_levels)
    metric = choose_metric(plan)
    names = list(candidates or (REGRESSORS if plan.problem == "regression" else CLASSIFIERS))
    table = training_table(df, plan)
    held, slots, errors = out_of_fold(table, plan, names)
    notes = [f"{n} evaluation failed: {e}" for n, e in errors.items()]
    found = _summaries(fold_scores(held, ["base", *slots.values()], plan, metric))
    default = 0.5 if metric == "ROC-AUC" else 0.0
    base_mean, base_std = found.get("base", (default, 0.0))
    scores: dict[str, dict[str, object]] = {"Baseline": {"mean": base_mean, "std": base_std}}
    winner, best = "Baseline", float("-inf")
    for name in names:
        if slots[name] not in found or name in errors:
            scores[name] = {"error": errors.get(name, "Cross-validation produced no finite scores.")}
            continue
        mean, std = found[slots[name]]
        scores[name] = {"mean": mean, "std": std}
        if mean > best:
            winner, best = name, mean
    singles = sorted((n for n in names if "mean" in scores[n]), key=lambda n: -scores[n]["mean"])
    members = [winner] if winner != "Baseline" else []
    if len(singles) >= ENSEMBLE_SIZE:
        top = singles[:ENSEMBLE_SIZE]
        cols = [F.col(slots[n]) for n in top]
        if plan.problem == "regression":
            mix = reduce(lambda a, b: a + b, cols) / len(top)
        else:
            mix = F.array(
                *[reduce(lambda a, b: a + b, [c[i] for c in cols]) / len(top) for i in range(len(plan.classes))]
            )
        mixed = held.withColumn("mix", mix)
        mean, std = _summaries(fold_scores(mixed, ["mix"], plan, metric))["mix"]
        scores["Ensemble"] = {"mean": mean, "std": std}
        kept = mean > scores[singles[0]]["mean"]
        notes.append(
            f"Ensemble of {', '.join(top)} ({metric} {mean:.4f}) "
            f"{'kept: beat' if kept else 'not kept: did not beat'} {singles[0]} ({scores[singles[0]]['mean']:.4f})."
        )
        if kept:
            winner, members = "Ensemble", top
    else:
        notes.append(f"Ensemble omitted: fewer than 3 single models were successfully evaluated ({len(singles)}).")
    return Tournament(plan, metric, table, held, slots, scores, winner, members, notes)


def verdict(margin: float, winner: str, best_std: float, base_std: float) -> str:
    """Reliability from the margin over the baseline against the fold spread."""
    weak = "weak: barely beats baseline"
    if winner == "Baseline" or margin < 0:
        return weak
    if margin >= max(STRONG_MARGIN, 3 * best_std):
        return "strong"
    if margin >= max(MODERATE_MARGIN, 2 * max(best_std, base_std)):
        return "moderate"
    return weak
