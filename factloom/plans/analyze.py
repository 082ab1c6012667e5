"""One analysis from a table to its results: the flow behind ``analyze``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import clean_value, col
from factloom.modeling.explain import global_drivers
from factloom.modeling.predict import contract_categories, predict_batch, schema_contract
from factloom.modeling.prep import ModelingError
from factloom.modeling.scoring import FittedModel, train
from factloom.operators import anomalies as A
from factloom.operators import charts, clusters, facts, forecast, segments
from factloom.operators.clean import CleanPlan, clean, clean_report
from factloom.operators.leakage import leaking_columns
from factloom.operators.order import column_quantiles, top_share
from factloom.operators.profile import column_facts, high_missing, inspect
from factloom.operators.relevance import relevance
from factloom.operators.semantic import profile
from factloom.session import deal, materialize


@dataclass
class Run:
    """Everything an analysis produced; tables stay lazy."""

    inspection: dict
    relevance: DataFrame
    cleaned: DataFrame
    cleaning: CleanPlan
    info: dict
    model: FittedModel | None = None
    leaderboard: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    findings: DataFrame | None = None
    recommendations: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def report(self, spark: SparkSession) -> DataFrame:
        return facts.report_tables(self.inspection, self.cleaning, self.model.card if self.model else None, spark)


class NotBusinessData(ValueError):
    """The table has no business signal, so it is not analysed."""


def analyze(
    spark: SparkSession,
    df: DataFrame,
    analysis_type: str = "auto",
    target: str | None = None,
    gate: bool = True,
    candidates: Sequence[str] | None = None,
) -> Run:
    """Inspect, gate, clean, then model or segment, find anomalies, forecast, and state the facts."""
    if not df.columns or not df.limit(1).count():
        raise ValueError("Uploaded file is empty.")
    # Some thirty passes read the table, so it is dealt over the cores once.
    df = materialize(deal(df, df.count()), "input")
    kind = "general" if analysis_type == "auto" else analysis_type
    inspection = inspect(df, analysis_type, target)
    score = relevance(df, "table")
    verdict = score.first()
    if gate and verdict["verdict"] == "not_business":
        raise NotBusinessData(f"No business-related columns found. Detected columns: {', '.join(df.columns[:8])}")
    _, first = profile(df, analysis_type, target)
    gaps = [r["column"] for r in high_missing(df).collect()]
    if first["target"]:
        # A row without an outcome teaches nothing, and a filled one would teach the fill.
        df = df.where(clean_value(first["target"], df.schema[first["target"]].dataType).isNotNull())
    cleaned, plan = clean(df)
    cleaned = materialize(cleaned, "cleaned")
    run = Run(inspection, score, cleaned, plan, {})
    cleaned, run.info = profile(cleaned, analysis_type, known=first)
    info = run.info
    if gate and verdict["verdict"] == "borderline":
        run.warnings.append("The table has few business indicators; results may be less specific.")
    goal = info["target"]
    run.tables.update(charts.exploratory_tables(cleaned, goal))
    run.tables["clean_report"] = clean_report(df, plan)
    run.tables["column_facts"] = column_facts(cleaned)
    said: list[tuple] = []
    advised: list[tuple] = []

    def add(pair: tuple) -> None:
        said.extend(pair[0])
        advised.extend(pair[1])

    leaking: list[str] = []
    if goal:
        found = leaking_columns(cleaned, goal, info["kinds"], info["problem"])
        leaking = sorted({r["column"] for r in found.select("column").distinct().collect()})
        usable = cleaned.drop(*leaking)
        try:
            run.model, game = train(usable, goal, candidates)
            run.leaderboard = game.leaderboard()
            _supervised(run, usable, goal, kind, add)
        except ModelingError as exc:
            run.warnings.append(f"Prediction skipped: {exc}")
    if not goal or run.model is None:
        found = clusters.segmentation(cleaned, info["numeric"], info["categorical"])
        if found:
            table, about = found
            names = clusters.usable_categories(cleaned, info["categorical"])
            run.tables["segmented"] = table.drop("features")
            run.tables["traits"] = clusters.segment_traits(table, "segment", info["numeric"], names)
            run.tables["scatter"] = clusters.segment_scatter(table)
            add(facts.cluster_facts(about, run.tables["traits"].collect()))
        said.extend(facts.correlation_facts(charts.strong_pairs(cleaned, info["numeric"]).collect() if len(info["numeric"]) >= 2 else []))
    flagged = A.anomalies(cleaned, info["numeric"])
    if flagged is not None:
        run.tables["anomalies"] = flagged
        first = A.top_anomalies(flagged, 1).first()
        add(facts.anomaly_facts(A.anomaly_summary(flagged).first(), first["reason"]))
    if "forecast" in info["plan"]:
        _forecast(run, cleaned, add)
    run.warnings.extend(facts.card_facts(info, run.model.card if run.model else None, leaking, gaps))
    run.findings = facts.rank_findings(said, spark)
    run.recommendations = facts.rank_advice(advised, spark)
    return run


def _supervised(run: Run, cleaned: DataFrame, goal: str, kind: str, add) -> None:
    model, info = run.model, run.info
    card = model.card
    run.warnings.extend(card["leakage_warnings"])
    run.tables["contract"] = schema_contract(cleaned, model.plan.features)
    run.tables["contract_categories"] = contract_categories(cleaned, model.plan.features)
    run.tables["drivers"] = global_drivers(model, cleaned)
    scored = predict_batch(model, cleaned)
    run.tables["scored"] = scored
    add(([("model", 0.7, f"Best model: {card['winner']} ({card['metric']} {card['winning_score']}).")], []))
    weight = {c: max((v for f, v in card["feature_importance"].items() if f == c or f.startswith(f"{c}_")), default=0.0) for c in model.plan.features}
    ranked = {c: v for c, v in sorted(weight.items(), key=lambda cv: -cv[1]) if v > 0}
    if model.plan.problem == "classification" and len(model.plan.classes) == 2:
        label = info["positive_label"]
        hit = F.coalesce((col(goal).cast("string") == label).cast("double"), F.lit(0.0))
        # The probability is that of the last class in text order.
        risk = F.col("probability") if label == model.plan.classes[1] else 1 - F.col("probability")
        ready = scored.withColumn("prediction_score", risk).withColumn("_hit", hit.cast("int"))
        run.tables["scored"] = ready.drop("_hit")
        add(facts.capture_facts(goal, label, segments.top_capture(ready, "prediction_score", "_hit").first(), kind))
        if ranked:
            picks = segments.segment_findings(segments.driver_segments(cleaned, ranked, hit))
            add(facts.segment_facts(picks, goal, label, model.plan.rows, kind))
    elif model.plan.problem == "regression":
        stats = cleaned.agg(F.avg(col(goal)).alias("m")).first()
        median = column_quantiles(cleaned, [goal], {"median": 0.5})[goal]["median"]
        add(facts.regression_facts(goal, stats["m"], median, top_share(cleaned, goal, 0.2).first()))
        if ranked:
            picks = segments.segment_findings(segments.driver_segments(cleaned, ranked, col(goal)))
            add(facts.segment_facts(picks, goal, None, model.plan.rows, kind))


def _forecast(run: Run, cleaned: DataFrame, add) -> None:
    info = run.info
    series = materialize(forecast.period_series(cleaned, info["time_column"], info["metric"]), "series")
    if not series.limit(1).count():
        return
    run.tables["series"] = series
    table = forecast.ridge_forecast(series)
    run.tables["forecast"] = forecast.forecast_points(table)
    last = series.orderBy(F.desc("t")).first()["y"]
    findings, advice, warnings = facts.forecast_facts(
        info["metric"], forecast.series_summary(series).first(), table.first(), last
    )
    add((findings, advice))
    run.warnings.extend(warnings)
