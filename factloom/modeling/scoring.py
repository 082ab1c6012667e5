"""The fitted winner: calibrated scoring, holdout evaluation, model card, save and load."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import col
from factloom.modeling import metrics as M
from factloom.modeling.prep import FeaturePlan, assign_folds, prep_pipeline, spread
from factloom.modeling.tournament import Tournament, candidate, predict_with, run_tournament, verdict
from factloom.operators.leakage import leakage_messages, leakage_warnings
from factloom.session import materialize, run_jobs

# Sizes used after the tournament.
CALIBRATION_FOLDS, TOP_FEATURES, RULE_LINES = 3, 10, 15
MARGIN_MODELS = ("Logistic Regression", "Gradient Boosting", "Gradient Boosting (shallow)")
EDGE = 1e-12


@dataclass
class Part:
    """One fitted preprocessing with its member models and, per class, a sigmoid (slope, offset)."""

    prep: PipelineModel
    members: list[tuple[str, Model]]
    sigmoid: list[tuple[float, float]] | None = None


@dataclass
class FittedModel:
    plan: FeaturePlan
    winner: str
    raw: Part
    parts: list[Part]
    threshold: float = 0.5
    card: dict = field(default_factory=dict)


def fit_part(train: DataFrame, plan: FeaturePlan, names: Sequence[str]) -> Part:
    prep = prep_pipeline(plan).fit(train)
    ready = prep.transform(train).select("features", "_y", "_w").persist()
    try:
        std = 1.0
        if plan.problem == "regression":
            std = ready.agg(F.stddev_pop("_y").alias("s")).first()["s"] or 1.0
        return Part(prep, [(n, candidate(n, plan, std).fit(ready)) for n in names])
    finally:
        ready.unpersist()


def part_output(part: Part, data: DataFrame, plan: FeaturePlan, name: str) -> DataFrame:
    """Adds the mean of the members: an array of class probabilities, or the number."""
    kept = data.columns
    scored = part.prep.transform(data).select(*[col(c) for c in kept], "features")
    slots = []
    for i, (member, model) in enumerate(part.members):
        slot = f"_m{i}"
        scored = predict_with(model, scored, plan, slot).select(*[col(c) for c in kept], "features", *slots, slot)
        slots.append(slot)
    if plan.problem == "regression":
        out = sum((F.col(s) for s in slots[1:]), F.col(slots[0])) / len(slots)
    else:
        out = F.array(
            *[
                sum((F.col(s)[k] for s in slots[1:]), F.col(slots[0])[k]) / len(slots)
                for k in range(len(plan.classes))
            ]
        )
    return scored.select(*[col(c) for c in kept], out.alias(name))


def _decision(p: Column, names: Sequence[str]) -> Column:
    """The value the sigmoid reads: log odds for margin models, else the probability."""
    if len(names) == 1 and names[0] in MARGIN_MODELS:
        safe = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
        return F.log(safe / (1 - safe))
    return p


def _fit_sigmoid(scored: DataFrame, value: Column, hit: Column) -> tuple[float, float]:
    """Logistic curve on smoothed targets, each row entered as both labels by weight."""
    counts = scored.agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("q")).first()
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["q"] + 2.0)
    goal = F.when(hit, high).otherwise(low)
    both = scored.select(
        value.alias("s"),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), goal.alias("w")),
                F.struct(F.lit(0.0).alias("label"), (1 - goal).alias("w")),
            )
        ).alias("t"),
    ).select("s", "t.label", "t.w")
    ready = VectorAssembler(inputCols=["s"], outputCol="v").transform(both)
    model = LogisticRegression(featuresCol="v", labelCol="label", weightCol="w", maxIter=200).fit(ready)
    return float(model.coefficients[0]), float(model.intercept)


def calibrated_parts(table: DataFrame, plan: FeaturePlan, names: Sequence[str]) -> list[Part]:
    """Up to three parts, each with sigmoids fitted on the fold its models did not see."""
    folds = min(CALIBRATION_FOLDS, min(plan.class_counts))
    if folds < 2:
        return []
    # Written, so that a fit reads a few file parts and no fold is ranked again by every pass of every fit.
    ranked = assign_folds(table.drop("_fold"), folds, plan.rows, "_y", seed=7)
    split = materialize(spread(ranked, plan.rows), "calibration")

    def calibrate(fold: int) -> Part:
        part = fit_part(split.filter(F.col("_fold") != fold), plan, names)
        held = part_output(part, split.filter(F.col("_fold") == fold), plan, "_p").select("_y", "_p").persist()
        try:
            classes = [1] if len(plan.classes) == 2 else range(len(plan.classes))
            part.sigmoid = [
                _fit_sigmoid(held, _decision(F.col("_p")[k], names), F.col("_y") == float(k)) for k in classes
            ]
        finally:
            held.unpersist()
        return part

    return run_jobs(table.sparkSession, calibrate, range(folds), folds)


def _calibrated(p: Column, part: Part, plan: FeaturePlan) -> Column:
    names = [n for n, _ in part.members]
    if part.sigmoid is None:
        return p
    curve = [
        1 / (1 + F.exp(-(F.lit(a) * _decision(p[k if len(plan.classes) > 2 else 1], names) + F.lit(b))))
        for k, (a, b) in enumerate(part.sigmoid)
    ]
    if len(plan.classes) == 2:
        return F.array(1 - curve[0], curve[0])
    values = F.array(*curve)
    total = F.aggregate(values, F.lit(0.0), lambda x, y: x + y)
    return F.transform(values, lambda v: v / F.greatest(total, F.lit(EDGE)))


def score_table(model: FittedModel, df: DataFrame, name: str = "_out") -> DataFrame:
    """Adds class probabilities averaged over the calibrated parts, or the predicted number."""
    parts = model.parts or [model.raw]
    kept = df.columns
    scored, slots = df, []
    for i, part in enumerate(parts):
        slot = f"_part{i}"
        scored = part_output(part, scored, model.plan, slot)
        if model.plan.problem == "classification":
            scored = scored.withColumn(slot, _calibrated(F.col(slot), part, model.plan))
        slots.append(slot)
    if model.plan.problem == "regression":
        out = F.col(slots[0])
    else:
        out = F.array(
            *[
                sum((F.col(s)[k] for s in slots[1:]), F.col(slots[0])[k]) / len(slots)
                for k in range(len(model.plan.classes))
            ]
        )
    return scored.select(*[col(c) for c in kept], out.alias(name))


def _best_class(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("double")


def feature_importance(part: Part, plan: FeaturePlan, top: int = TOP_FEATURES) -> dict[str, float]:
    """Tree importances or absolute coefficients; the mean of normalised ones over members."""
    names = plan.feature_names
    lists = []
    for _, model in part.members:
        if hasattr(model, "featureImportances"):
            values = list(model.featureImportances.toArray())
        elif hasattr(model, "coefficientMatrix"):
            # One row per class, or one for two classes.
            values = [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
        elif hasattr(model, "coefficients"):
            values = [abs(v) for v in model.coefficients.toArray()]
        else:
            values = [0.0] * len(names)
            inside = [m for m in model.stages if hasattr(m, "featureImportances")]
            for inner in inside:
                for i, v in enumerate(inner.featureImportances.toArray()):
                    values[i] += v / len(inside)
        lists.append(values)
    if len(lists) > 1:
        lists = [[v / (sum(vs) or 1.0) for v in vs] for vs in lists]
    mean = [sum(vs) / len(lists) for vs in zip(*lists)]
    ranked = sorted(zip(names, mean), key=lambda nv: -nv[1])[:top]
    return {n: round(float(v), 4) for n, v in ranked}


def decision_rules(table: DataFrame, plan: FeaturePlan) -> str:
    """The first lines of a depth-4 tree with feature names."""
    part = fit_part(table, plan, ["Decision Tree"])
    text = part.members[0][1].toDebugString
    names = plan.feature_names
    for i in range(len(names) - 1, -1, -1):
        text = text.replace(f"feature {i} ", f"{names[i]} ")
    lines = [line for line in text.splitlines()[1:] if line.strip()]
    return "\n".join(lines[:RULE_LINES])


def holdout(model_parts: list[Part], raw: Part, table: DataFrame, plan: FeaturePlan, spark: SparkSession) -> dict[str, object]:
    """Metrics on the fifth of the rows no part has seen."""
    test = table.filter("_test")
    scored = part_output(raw, test, plan, "_raw")
    if plan.problem == "regression":
        row = M.regression_metrics(scored, "_y", "_raw").first()
        return {"mae": row["mae"], "r2": row["r2"], "test_rows": row["row_count"], "threshold": 0.5}
    if model_parts:
        fitted = FittedModel(plan, "", raw, model_parts)
        scored = score_table(fitted, scored, "_cal")
    else:
        scored = scored.withColumn("_cal", F.col("_raw"))
    scored = scored.select("_y", "_raw", "_cal").persist()
    try:
        cells = M.confusion(scored, F.col("_y").cast("int"), _best_class(F.col("_raw")).cast("int")).collect()
        cell_table = spark.createDataFrame(cells, "actual string, predicted string, n bigint")
        out: dict[str, object] = {
            "confusion": {(int(r["actual"]), int(r["predicted"])): r["n"] for r in cells},
            "report": {r["class"]: r.asDict() for r in M.class_report(cell_table).collect()},
            "accuracy": M.accuracy(cell_table).first()["accuracy"],
            "test_rows": sum(r["n"] for r in cells),
            "threshold": 0.5,
        }
        gaps = [
            F.avg(F.pow(F.col("_cal")[k] - (F.col("_y") == float(k)).cast("double"), F.lit(2))).alias(f"b{k}")
            for k in ([1] if len(plan.classes) == 2 else range(len(plan.classes)))
        ]
        briers = scored.agg(*gaps).first()
        out["brier"] = sum(briers) / len(briers)
        if len(plan.classes) == 2:
            table_ = M.threshold_table(
                scored.select("_y", F.col("_cal")[1].alias("p")), "p", F.col("_y") == 1.0
            )
            best = M.best_threshold(table_).first()
            out["threshold"], out["min_cost"] = best["threshold"], best["cost"]
        return out
    finally:
        scored.unpersist()


def train(df: DataFrame, target: str, candidates: Sequence[str] | None = None, max_levels: int | None = None) -> tuple[FittedModel, Tournament]:
    """Tournament, calibration, holdout and model card."""
    started = time.monotonic()
    spark = df.sparkSession
    game = run_tournament(df, target, candidates, max_levels)
    plan, table = game.plan, game.table
    names = game.members or ["Ridge" if plan.problem == "regression" else "Logistic Regression"]
    seen = table.filter("not _test")
    classification = plan.problem == "classification"
    trial = fit_part(seen, plan, names)
    trial_parts = calibrated_parts(seen, plan, names) if classification else []
    results = holdout(trial_parts, trial, table, plan, spark)
    raw = fit_part(table, plan, names)
    parts = calibrated_parts(table, plan, names) if classification else []

    best, base = game.scores[game.winner], game.scores["Baseline"]
    margin = best["mean"] - base["mean"]
    leaks = leakage_messages(leakage_warnings(df.select(*[col(f) for f in plan.features], col(target)), target, classification))
    card = {
        "dataset_size": plan.rows,
        "features_used": plan.features,
        "metric": game.metric,
        "winner": game.winner,
        "winning_score": round(best["mean"], 4),
        "cv_std": round(best["std"], 4),
        "baseline_score": round(base["mean"], 4),
        "cv_scores": {n: {k: (round(v, 4) if isinstance(v, float) else v) for k, v in s.items()} for n, s in game.scores.items()},
        "reliability_verdict": verdict(margin, game.winner, best["std"], base["std"]),
        "why_it_won": f"Highest cross-validated {game.metric} ({best['mean']:.4f}); improvement over baseline is {margin:+.4f}.",
        "feature_importance": feature_importance(raw, plan),
        "decision_rules": decision_rules(table, plan),
        "ensemble_kept": game.winner == "Ensemble",
        "threshold": results["threshold"],
        "min_cost": results.get("min_cost"),
        "accuracy": results.get("accuracy"),
        "brier_score": results.get("brier"),
        "mae": results.get("mae"),
        "confusion": [[k[0], k[1], n] for k, n in sorted(results.get("confusion", {}).items())],
        "report": results.get("report", {}),
        "train_rows": plan.rows - results["test_rows"],
        "test_rows": results["test_rows"],
        "warnings": [*leaks, *game.notes],
        "leakage_warnings": leaks,
        "seconds": round(time.monotonic() - started, 2),
    }
    return FittedModel(plan, game.winner, raw, parts, float(results["threshold"]), card), game


def _save_part(part: Part, path: str) -> None:
    part.prep.write().overwrite().save(f"{path}/prep")
    for i, (_, model) in enumerate(part.members):
        PipelineModel([model]).write().overwrite().save(f"{path}/member{i}")


def save_model(model: FittedModel, path: str, spark: SparkSession) -> None:
    """Pipelines first, the metadata row last, so a half-written model never loads."""
    _save_part(model.raw, f"{path}/raw")
    for i, part in enumerate(model.parts):
        _save_part(part, f"{path}/part{i}")
    meta = {
        "plan": model.plan.as_dict(),
        "winner": model.winner,
        "threshold": model.threshold,
        "card": model.card,
        "members": [n for n, _ in model.raw.members],
        "sigmoids": [p.sigmoid for p in model.parts],
    }
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _load_part(path: str, names: Sequence[str], sigmoid=None) -> Part:
    members = [(n, PipelineModel.load(f"{path}/member{i}").stages[0]) for i, n in enumerate(names)]
    return Part(PipelineModel.load(f"{path}/prep"), members, [tuple(s) for s in sigmoid] if sigmoid else None)


def load_model(spark: SparkSession, path: str) -> FittedModel:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as exc:
        raise FileNotFoundError(f"No trained model found at '{path}'.") from exc
    meta = json.loads(row["meta"])
    names = meta["members"]
    parts = [_load_part(f"{path}/part{i}", names, s) for i, s in enumerate(meta["sigmoids"])]
    return FittedModel(
        FeaturePlan(**meta["plan"]), meta["winner"], _load_part(f"{path}/raw", names), parts,
        meta["threshold"], meta["card"],
    )
