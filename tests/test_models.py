"""Model training, validation, prediction and explanation on small seeded tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import SF, subscribers
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from factloom.modeling import explain, metrics, predict, scoring, tournament
from factloom.modeling.prep import ModelingError, plan_features, prep_pipeline
from factloom.modeling.softmax import SoftmaxBoosting
from factloom.modeling.tournament import class_scores
from factloom.plans.analyze import NotBusinessData, analyze
from factloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def signal(spark):
    """Churn follows contract and tenure with some noise."""
    pdf = subscribers(400, 7)
    odds = 1.8 * (pdf["Contract"] == "Month-to-month") - 0.06 * pdf["tenure"] + 0.02 * pdf["MonthlyCharges"]
    rng = np.random.default_rng(1)
    pdf["Churn"] = np.where(rng.random(400) < 1 / (1 + np.exp(-odds)), "Yes", "No")
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def trained(signal):
    return scoring.train(signal, "Churn", ("Logistic Regression", "Decision Tree"))


def test_signal_beats_baseline(trained):
    model, game = trained
    board = {r["candidate"]: r for r in game.leaderboard().collect()}
    assert board[game.winner]["mean"] > 0.7 > board["Baseline"]["mean"]
    assert model.card["reliability_verdict"] in ("strong", "moderate") and 0.1 <= model.threshold <= 0.9
    assert sum(n for *_, n in model.card["confusion"]) == model.card["test_rows"]
    assert model.card["train_rows"] + model.card["test_rows"] == 400 and 0 < model.card["brier_score"] < 0.25
    assert "If (" in model.card["decision_rules"]


def test_noise_is_called_weak(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(100, 3)), columns=["f1", "f2", "f3"]).assign(noise_target=rng.integers(0, 2, 100))
    model, _ = scoring.train(spark.createDataFrame(pdf), "noise_target", ("Logistic Regression",))
    assert model.card["reliability_verdict"] == "weak: barely beats baseline"


@pytest.mark.parametrize(
    "change, target, message",
    [
        (lambda d: d, "nothing", "not present"),
        (lambda d: d.limit(10), "Churn", "Insufficient sample size"),
        (lambda d: d.withColumn("Churn", F.lit("No")), "Churn", "unique value"),
        (lambda d: d.select("Churn"), "Churn", "No valid predictor"),
    ],
)
def test_guards(signal, change, target, message):
    with pytest.raises(ModelingError, match=message):
        plan_features(change(signal), target)


def test_saved_model_scores_the_same(spark, signal, trained, tmp_path):
    model, _ = trained
    scoring.save_model(model, str(tmp_path / "m"), spark)
    again = scoring.load_model(spark, str(tmp_path / "m"))
    names = ["tenure", "probability", "prediction", "risk_tier"]
    first = sorted(map(tuple, predict.predict_batch(model, signal).select(*names).collect()))
    assert sorted(map(tuple, predict.predict_batch(again, signal).select(*names).collect())) == first
    assert {r[3] for r in first} <= {"Low", "Medium", "High"} and all(0 <= r[1] <= 1 for r in first)
    with pytest.raises(FileNotFoundError):
        scoring.load_model(spark, str(tmp_path / "none"))


def test_unknown_levels_and_nulls_are_scored(spark, trained):
    new = spark.createDataFrame([(None, 50.0, "Ten year"), (5, None, None)], "tenure int, MonthlyCharges double, Contract string")
    assert predict.predict_batch(trained[0], new).filter("probability is null").count() == 0


def test_validation(spark, signal):
    features = ["tenure", "MonthlyCharges", "Contract"]
    contract, categories = predict.schema_contract(signal, features), predict.contract_categories(signal, features)
    rows = [("12", "50", "One year"), ("12", "50", ""), ("12", "50", "Ten year"), ("12", "9999", "One year"), ("-5", "50", "One year"), ("x", "50", "One year"), (None, None, "One year")]
    df = spark.createDataFrame(rows, "tenure string, MonthlyCharges string, Contract string")
    checked = predict.validate_rows(df, contract, categories)
    good, bad = predict.split_valid(checked)
    assert good.count() == 1 and good.columns == features
    messages = [r["violation"] for r in bad.collect()]
    for part in ("Missing required field(s): Contract", "Unknown category 'Ten year'", "Maximum allowed", "Minimum allowed", "Invalid numeric value 'x'", "Missing required field(s): tenure, MonthlyCharges"):
        assert sum(part in m for m in messages) == 1, part


@pytest.mark.parametrize("n", [3, 40])
def test_categories_are_joined_and_the_first_are_named(spark, n):
    known = [f"v{i:02d}" for i in range(n)]
    base = spark.createDataFrame([(v,) for v in known], "c string")
    new = spark.createDataFrame([(known[-1],), ("z",)], "c string")
    checked = predict.validate_rows(new, predict.schema_contract(base), predict.contract_categories(base)).collect()
    told = f"Unknown category 'z' for field 'c'. Allowed categories: {', '.join(known[:25])}"
    assert {r["c"]: r["violation"] for r in checked} == {known[-1]: None, "z": told}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = x @ [3.0, -2.0, 0.5] * 10 + rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y))
    plan = plan_features(df, "y")
    ready = prep_pipeline(plan).fit(df).transform(df).withColumnRenamed("y", "_y").withColumn("_w", F.lit(1.0))
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    for name, tol in (("Ridge", 1e-6), ("Lasso", 1e-4), ("ElasticNet", 1e-4)):
        model = tournament.candidate(name, plan, float(np.std(y))).fit(ready)
        w, centred = model.coefficients.toArray(), y - y.mean()
        residual = centred - scaled @ w
        gradient = scaled.T @ residual
        if name == "Ridge":
            assert np.allclose(gradient, w, atol=tol * 100)
        elif name == "Lasso":
            assert np.allclose(gradient / 60, np.sign(w), atol=0.02)
        else:
            assert np.allclose(gradient / 60, 0.5 * np.sign(w) + 0.5 * w, atol=0.02)


def test_rank_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)], "s double, y int")
    row = metrics.rank_metrics(df, "s", F.col("y") == 1).first()
    # Pairs won: 2 + 1.5 + 0 of 6; precision at the hit scores 1, 2/3, 3/5.
    assert row["auc"] == pytest.approx(3.5 / 6) and row["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_tree_paths_add_up(spark, signal, trained):
    model, game = trained
    for name in ("Decision Tree", "Random Forest", "Gradient Boosting"):
        part = scoring.fit_part(game.table, game.plan, [name])
        fitted = scoring.FittedModel(game.plan, name, part, [])
        scored, how = explain.with_contributions(fitted, signal)
        assert "not SHAP" in how
        sums = np.array([sum(r["_contrib"]) for r in scored.orderBy("tenure", "MonthlyCharges").select("_contrib").collect()])
        out = scoring.part_output(part, signal, game.plan, "_p").orderBy("tenure", "MonthlyCharges").select("_p").collect()
        p = np.array([r["_p"][1] for r in out])
        if name == "Gradient Boosting":
            p = np.log(p / (1 - p)) / 2
        # The contributions explain the distance from one common starting value.
        assert np.ptp(p - sums) < 1e-6, name


def test_reasons(spark, signal, trained):
    reasons = explain.row_reasons(trained[0], signal.limit(5)).select("reasons").collect()
    assert all(len(r["reasons"]) == 3 and "impact" in r["reasons"][0] for r in reasons)
    drivers = explain.global_drivers(trained[0], signal).collect()
    assert drivers[0]["weight"] >= drivers[-1]["weight"] and "tenure" in {d["feature"] for d in drivers}
    assert len(explain.importance_reasons(signal, {}).first()["reasons"]) == 3


def test_three_classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=240)
    pdf = pd.DataFrame({"x": x, "z": rng.normal(size=240), "level": np.where(x < -0.5, "low", np.where(x < 0.5, "mid", "top"))})
    model, game = scoring.train(spark.createDataFrame(pdf), "level", ("Logistic Regression", "Decision Tree"))
    assert game.scores[game.winner]["mean"] > 0.9
    out = predict.predict_batch(model, spark.createDataFrame(pdf))
    assert out.filter("prediction = level").count() > 200


def test_softmax_boosting(spark, tmp_path):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(2, 400))
    y = np.where(x * z < -0.3, 0.0, np.where(x * z < 0.3, 1.0, 2.0))
    data = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "_y": y, "_w": 1.0}))
    )
    losses = []
    for rounds in (1, 6):
        model = SoftmaxBoosting(3, rounds, depth=3, step=0.5).fit(data)
        p = np.array([r["_p"] for r in class_scores(model, data.select("features", "x", "z"), 3).collect()])
        assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
        losses.append(-np.log(p[np.arange(400), y.astype(int)]).mean())
    assert losses[1] < losses[0] < 1.1 and (p.argmax(axis=1) == y).mean() > 0.85

    # Stored and read back it scores the same.
    model.write().overwrite().save(str(tmp_path / "model"))
    again = np.array([r["_p"] for r in class_scores(PipelineModel.load(str(tmp_path / "model")), data.select("features", "x", "z"), 3).collect()])
    assert np.allclose(again, p)

    # A class without rows keeps a tiny share.
    lone = class_scores(SoftmaxBoosting(4, 1, depth=2).fit(data), data.select("features"), 4).first()["_p"]
    assert len(lone) == 4 and lone[3] < 1e-3


def test_boosting_of_three_classes_in_training(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tournament, "BOOST_ROUNDS", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=150)
    pdf = pd.DataFrame({"x": x, "z": rng.normal(size=150), "level": np.where(x < -0.5, "low", np.where(x < 0.5, "mid", "top"))})
    df = spark.createDataFrame(pdf)
    model, game = scoring.train(df, "level", ("Gradient Boosting",))
    assert game.winner == "Gradient Boosting" and game.scores[game.winner]["mean"] > 0.8
    scoring.save_model(model, str(tmp_path / "three"), spark)
    out = predict.predict_batch(scoring.load_model(spark, str(tmp_path / "three")), df)
    assert out.filter("prediction = level").count() > 120
    assert explain.global_drivers(model, df).first()["feature"] == "x"


def test_stream_of_rows(spark, signal, trained, tmp_path):
    features = ["tenure", "MonthlyCharges", "Contract"]
    contract, categories = predict.schema_contract(signal, features), predict.contract_categories(signal, features)
    source = signal.select(*features).union(spark.createDataFrame([(5, 50.0, "Ten year")], "tenure bigint, MonthlyCharges double, Contract string"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for q in score_stream(stream, trained[0], contract, categories, str(tmp_path / "out"), str(tmp_path / "cp")):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/scored")).filter("probability between 0 and 1").count() == 400
    rejected = spark.read.parquet(str(tmp_path / "out/quarantine")).collect()
    assert len(rejected) == 1 and "Ten year" in rejected[0]["violation"]


def test_analysis_with_outcome(spark, signal):
    run = analyze(spark, signal, "churn", candidates=("Logistic Regression", "Decision Tree"))
    assert run.info["target"] == "Churn" and run.model is not None
    kinds = {r["kind"] for r in run.findings.collect()}
    assert {"model", "base_rate", "gains"} <= kinds
    assert run.recommendations.orderBy("priority").first()["title"].startswith("Start with the 40")
    assert run.report(spark).filter("section = 'benchmark'").count() == 3
    assert run.tables["scored"].count() == run.cleaned.count()


def test_analysis_without_business_columns(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(20)], "petal_width double, sepal_width double")
    with pytest.raises(NotBusinessData):
        analyze(spark, df.select((F.col("petal_width") / 100).alias("petal_width"), (F.col("sepal_width") / 100).alias("sepal_width")))


def test_empty_table(spark):
    with pytest.raises(ValueError, match="empty"):
        analyze(spark, spark.createDataFrame([], "a int"))


def test_permutation_drivers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=400), "z": rng.normal(size=400), "flat": np.ones(400), "kind": rng.choice(["a", "b", "c"], 400)})
    pdf["hit"] = np.where(pdf["x"] + rng.normal(size=400) * 0.2 > 0, "Yes", "No")
    df = spark.createDataFrame(pdf)
    model, _ = scoring.train(df, "hit", ("Decision Tree",))
    found = {r["column"]: r for r in explain.permutation_drivers(model, df).collect()}
    assert set(found) == {"x", "z", "flat", "kind"}
    assert found["flat"]["importance"] == 0 and found["x"]["importance"] > 0.3
    assert found["x"]["importance"] > 5 * abs(found["z"]["importance"])


def test_trained_tries_all_candidates(spark, monkeypatch):
    """The training behind the model queries leaves out no candidate."""
    from factloom.plans import model_queries

    asked = []

    def noted(df, target, candidates=None, max_levels=None):
        asked.append((candidates or tournament.CLASSIFIERS, max_levels))
        return "model", "game"

    monkeypatch.setattr(model_queries, "train", noted)
    monkeypatch.setattr(model_queries, "_TRAINED", {})
    assert model_queries.trained(spark, SF) == ("model", "game")
    assert asked == [(tournament.CLASSIFIERS, None)]


def test_analysis_findings_tries_all_candidates(spark, monkeypatch):
    """The full flow leaves the choice of candidates to the training, which then tries all."""
    from types import SimpleNamespace

    from factloom.plans import insight_queries

    asked = []

    def noted(spark, df, analysis_type="auto", target=None, gate=True, candidates=None):
        asked.append((target, candidates or tournament.REGRESSORS))
        return SimpleNamespace(findings="findings")

    monkeypatch.setattr(insight_queries, "analyze", noted)
    assert insight_queries.analysis_findings(spark, SF) == "findings"
    assert asked == [("value", tournament.REGRESSORS)]


def test_all_candidates_are_scored(spark, signal):
    """Without a choice every candidate of the kind has a line of its own."""
    game = tournament.run_tournament(signal, "Churn")
    assert set(tournament.CLASSIFIERS) <= {r["candidate"] for r in game.leaderboard().collect() if r["mean"] is not None}


def test_all_levels_are_kept_unless_limited(spark):
    df = spark.createDataFrame([(i % 2, f"level {i % 150}", float(i)) for i in range(600)], "y int, city string, x double")
    assert len(plan_features(df, "y").levels["city"]) == 150
    few = plan_features(df, "y", max_levels=20).levels["city"]
    assert len(few) == 21 and few[-1] == "__OTHER__"


def test_training_rows_are_dealt_over_tasks(spark):
    """A fit is not left to the one file that the ranking of a small table ends in."""
    from pyspark.sql import functions as F

    from factloom.modeling.prep import ROWS_PER_TASK, plan_features, training_table

    rows = 3 * ROWS_PER_TASK
    data = spark.range(rows).select((F.col("id") % 977).alias("amount"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    table = training_table(data, plan_features(data, "kind"))
    held = table.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(held) == 3 and sum(r["n"] for r in held) == rows
    assert {r["n"] for r in table.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()} == {rows // 5}


def test_forests_keep_the_nodes_of_rows(spark):
    """Deep forests do not seek a row's node from the root at each level; the trees are the same either way."""
    from pyspark.ml.linalg import Vectors

    from factloom.modeling.prep import FeaturePlan
    from factloom.modeling.tournament import candidate

    rng = np.random.default_rng(5)
    rows = [(Vectors.dense(*x), float(x[0] > 0.3 * x[1]), 1.0) for x in rng.normal(size=(300, 4)).tolist()]
    data = spark.createDataFrame(rows, ["features", "_y", "_w"])
    for problem in ("classification", "regression"):
        plan = FeaturePlan("y", problem, 300, ["0.0", "1.0"] if problem == "classification" else [])
        for name in ("Random Forest", "Random Forest (no bootstrap)"):
            forest = candidate(name, plan)
            assert forest.getCacheNodeIds()
            kept, sought = (f.fit(data).toDebugString.split("\n", 1)[1] for f in (forest, forest.copy({forest.cacheNodeIds: False})))
            assert kept == sought


def test_permuted_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Scoring every row once a column is not left to the few buckets of the ranking."""
    from factloom.modeling.prep import ROWS_PER_TASK
    from factloom.session import materialize

    rows = 3 * ROWS_PER_TASK
    number = (F.col("id") % 977).cast("double")
    df = spark.range(rows).select(number.alias("amount"), F.when(number + F.col("id") % 7 > 400, "a").otherwise("b").alias("kind"))
    plan = plan_features(df, "kind")
    part = scoring.fit_part(df.withColumn("_y", (F.col("kind") == "b").cast("double")).withColumn("_w", F.lit(1.0)), plan, ["Decision Tree"])
    written = []

    def kept(data, label):
        written.append(materialize(data, label))
        return written[-1]

    monkeypatch.setattr(explain, "materialize", kept)
    found = {r["column"]: r for r in explain.permutation_drivers(scoring.FittedModel(plan, "Decision Tree", part, []), df).collect()}
    dealt = written[1].groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(dealt) == 3 and sum(r["n"] for r in dealt) == rows
    assert found["amount"]["importance"] > 0.3
