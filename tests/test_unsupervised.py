"""Forecasts against direct numpy arithmetic; anomalies and segments on planted structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import anomalies, clusters, forecast
from factloom.session import materialize


def daily(n: int = 70, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    days = pd.date_range("2024-01-01", periods=n, freq="D")
    y = 100 + 2.0 * np.arange(n) + 30 * (days.dayofweek == 5) + rng.normal(0, 3, n)
    return pd.DataFrame({"day": days, "revenue": y})


def ridge(x, y):
    mean = x.mean(0)
    w = np.linalg.solve((x - mean).T @ (x - mean) + np.eye(x.shape[1]), (x - mean).T @ (y - y.mean()))
    return lambda z: (z - mean) @ w + y.mean()


def test_forecast_equals_direct_arithmetic(spark):
    pdf = daily()
    series = forecast.period_series(spark.createDataFrame(pdf), "day", "revenue")
    row = forecast.ridge_forecast(series).first()
    n = len(pdf)
    x = lambda t: np.hstack([t[:, None], np.eye(7)[t % 7]])
    full = ridge(x(np.arange(n)), pdf["revenue"].to_numpy())
    assert row["forecast"] == pytest.approx(full(x(np.arange(n, n + 7))), abs=0.01)
    held = 12
    part = ridge(x(np.arange(n - held)), pdf["revenue"].to_numpy()[:-held])
    gap = np.abs(part(x(np.arange(n - held, n))) - pdf["revenue"].to_numpy()[-held:])
    assert row["mae"] == pytest.approx(gap.mean(), abs=0.01) and row["beats_naive"]
    assert str(row["forecast_period"][0]) == "2024-03-11"
    about = forecast.series_summary(series).first()
    assert about["peak"] == "Saturday" and about["trend_per_period"] == pytest.approx(np.polyfit(np.arange(n), pdf["revenue"], 1)[0])


def test_gaps_and_many_series(spark):
    pdf = pd.concat([daily(40, s).assign(shop=f"s{s}") for s in range(5)])
    pdf = pdf[pdf["day"].dt.day != 10]
    found = forecast.period_series(spark.createDataFrame(pdf), "day", "revenue", ["shop"])
    counts = {r["shop"]: r["count"] for r in found.groupBy("shop").count().collect()}
    assert counts == {f"s{s}": 40 for s in range(5)}
    assert found.filter("y = 0").count() == 5
    rated = spark.createDataFrame(pdf.rename(columns={"revenue": "rating"}))
    filled = forecast.period_series(rated, "day", "rating", ["shop"]).filter("shop = 's0'").orderBy("period").toPandas()
    whole = pdf[pdf["shop"] == "s0"].set_index("day")["revenue"].asfreq("D").interpolate()
    assert np.allclose(filled["y"], whole)
    assert forecast.ridge_forecast(found, ["shop"]).count() == 5


def test_weeks_and_months_drop_partial_ends(spark):
    half = pd.DataFrame({"day": pd.date_range("2024-01-03", "2024-08-14"), "v": 1.0})
    weeks = forecast.period_series(spark.createDataFrame(half), "day", "v").orderBy("t").toPandas()
    assert set(weeks["grain"]) == {"week"} and set(weeks["y"]) == {7.0} and str(weeks["period"].iloc[0]) == "2024-01-08"
    long = pd.DataFrame({"day": pd.date_range("2020-01-15", "2023-06-30"), "v": 1.0})
    months = forecast.period_series(spark.createDataFrame(long), "day", "v").orderBy("t").toPandas()
    assert set(months["grain"]) == {"month"} and str(months["period"].iloc[0]) == "2020-02-01" and str(months["period"].iloc[-1]) == "2023-06-01"


def test_short_series_are_left_out(spark):
    assert forecast.period_series(spark.createDataFrame(daily(13)), "day", "revenue").count() == 0


def test_extreme_values_are_capped(spark):
    pdf = daily(100)
    pdf.loc[50, "revenue"] = 500_000.0
    pdf = pd.concat([pdf] * 5)
    pdf.loc[(pdf["revenue"] == 500_000.0) & (np.arange(len(pdf)) > 100), "revenue"] = 100.0
    series = forecast.period_series(spark.createDataFrame(pdf), "day", "revenue")
    row = series.orderBy(F.desc("y")).first()
    assert row["outliers"] > 0 and row["y"] < 100_000


@pytest.fixture(scope="module")
def spiked(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(500), "a": rng.normal(10, 1, 500), "b": rng.normal(0, 5, 500)})
    pdf.loc[50, "a"] = 500.0
    pdf.loc[100:400, "b"] = 1.0
    return spark.createDataFrame(pdf)


def test_planted_outlier_comes_first(spiked):
    flagged = anomalies.anomalies(spiked, ["a", "b"])
    first = anomalies.top_anomalies(flagged, 1).first()
    assert first["id"] == 50 and first["extreme"] and first["reason"].startswith("a = 500.00")
    about = anomalies.anomaly_summary(flagged).first()
    assert about["extreme_count"] >= 1 and 0.015 <= about["share"] <= 0.2
    inner = flagged.filter("abs(a - 10) < 0.5 and abs(b) < 2").agg(F.avg("anomaly_score")).first()[0]
    assert first["anomaly_score"] > inner


def test_scores_do_not_depend_on_the_run(spiked):
    base = materialize(anomalies.robust_z(spiked, ["a", "b"]).coalesce(1))
    one, two = (anomalies.isolation_scores(base, ["a", "b"]).orderBy("id").select("anomaly_score").toPandas() for _ in range(2))
    assert np.allclose(one, two)


def test_path_length_formula():
    assert anomalies._expected_path(1) == 0 and anomalies._expected_path(2) == 1
    assert anomalies._expected_path(256) == pytest.approx(10.244, abs=1e-3)


def test_too_little_data(spark):
    assert anomalies.anomalies(spark.range(10).toDF("x"), ["x"]) is None
    assert clusters.segmentation(spark.range(10).toDF("x"), ["x"], []) is None


def test_planted_segments(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"spend": np.concatenate([rng.normal(10, 1, 100), rng.normal(90, 1, 100)]), "visits": np.concatenate([rng.normal(5, 1, 100), rng.normal(50, 1, 100)]),
         "plan": ["basic"] * 100 + ["gold"] * 100}
    )
    table, about = clusters.segmentation(spark.createDataFrame(pdf), ["spend", "visits"], ["plan"])
    assert about["k"] == 2 and about["silhouette"] > 0.9
    assert {r["count"] for r in table.groupBy("segment", "plan").count().collect()} == {100}
    traits = clusters.segment_traits(table, "segment", ["spend", "visits"], ["plan"]).collect()
    assert len(traits) == 6 and any("plan = gold (100% vs 50% overall)" == t["trait"] for t in traits)
    assert clusters.segment_scatter(table).count() == 200


@pytest.mark.parametrize("per_bucket", [100_000, 150, 7])
def test_folds_are_the_same_however_the_work_is_cut(spark, monkeypatch, per_bucket):
    from factloom.modeling import prep

    df = materialize(spark.range(1000).select(F.col("id").alias("_place"), (F.col("id") % 100 == 0).cast("int").alias("y")), "folds")
    whole = {r["_place"]: r["_fold"] for r in prep.assign_folds(df, 5, 1000, "y").collect()}
    monkeypatch.setattr(prep, "ROWS_PER_BUCKET", per_bucket)
    cut = {r["_place"]: r["_fold"] for r in prep.assign_folds(df, 5, 1000, "y").collect()}
    assert cut == whole
    sizes = pd.Series(cut).groupby([pd.Series({k: int(k % 100 == 0) for k in cut}), pd.Series(cut)]).size()
    assert set(sizes[0]) == {198} and set(sizes[1]) == {2}


def test_a_table_without_an_outcome_is_not_modelled(spark):
    from factloom.plans.analyze import analyze

    rng = np.random.default_rng(1)
    sales = pd.DataFrame({
        "date": pd.date_range("2025-01-01", periods=400), "region": rng.choice(["N", "S", "W"], 400),
        "units": rng.poisson(20, 400), "revenue": rng.gamma(5, 40, 400),
    })
    run = analyze(spark, spark.createDataFrame(sales), gate=False)
    assert run.info["target"] is None and run.model is None
    kinds = {r["kind"] for r in run.findings.collect()}
    assert {"segments", "trend", "forecast"} <= kinds
    assert run.info["metric"] == "revenue"


def test_rows_without_an_outcome_are_left_out(spark):
    from factloom.plans.analyze import analyze

    rng = np.random.default_rng(2)
    df = pd.DataFrame({"spend": rng.normal(50, 9, 240), "visits": rng.poisson(5, 240)})
    df["churn"] = np.where(df["spend"] + rng.normal(0, 3, 240) > 50, "Yes", "No")
    df.loc[::6, "churn"] = None
    run = analyze(spark, spark.createDataFrame(df), "churn", gate=False, candidates=("Logistic Regression",))
    assert run.model is not None and run.model.plan.rows == 200


def test_bit_vectors_give_the_scores_of_the_walk(spiked):
    base = materialize(anomalies.robust_z(spiked, ["a", "b"]))
    nodes, size = anomalies.isolation_trees(base, base.count(), ["a", "b"])
    values = base.select("a", "b").toPandas().to_numpy()
    values = np.concatenate([values, nodes["cut"].to_numpy()[:400].reshape(-1, 2), [[np.nan, 1.0], [np.inf, -np.inf]]])
    depth = np.zeros(len(values))
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("node")
        for i, row in enumerate(values):
            at = 0
            while tree["feature"].iat[at] >= 0:
                at = tree["left"].iat[at] if row[tree["feature"].iat[at]] <= tree["cut"].iat[at] else tree["right"].iat[at]
            depth[i] += tree["path"].iat[at]
        if tree["tree"].iat[0] == 11:
            break
    few = nodes[nodes["tree"] <= 11]
    assert few["tree"].nunique() == 12
    assert np.allclose(anomalies.mean_path(anomalies.leaf_masks(few, 2), values), depth / 12)


def test_draws_follow_the_binomial_numbers():
    limits = anomalies._draw_limits(0.01)
    assert limits[0] == pytest.approx(0.99**200) and limits == sorted(limits) and limits[-1] == pytest.approx(1)
    assert anomalies._draw_limits(1.0) == [0.0] * 200


def test_every_tree_gets_its_rows(spark):
    data = materialize(spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS x"))
    sample, size = anomalies._forest_sample(data, 3000, ["x"])
    counts = [r["count"] for r in sample.groupBy("tree").count().collect()]
    assert size == 256 and len(counts) == 200 and set(counts) == {256}
    assert sample.groupBy("tree", "_key").count().where("count > 1").count() == 0
    tiny, _ = anomalies._forest_sample(materialize(spark.range(60).selectExpr("CAST(id AS DOUBLE) AS x")), 60, ["x"])
    assert tiny.count() == 60 * 200


def test_rows_are_dealt_over_the_cores(spark):
    """One input partition does not leave scoring and clustering to one task."""
    rows = 4 * 5_000
    narrow = materialize(spark.range(rows).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 97 AS DOUBLE) AS b").coalesce(1))
    flagged = anomalies.anomalies(narrow, ["a", "b"])
    table, _ = clusters.segmentation(narrow, ["a", "b"], [], max_k=2)
    assert len(flagged.inputFiles()) > 1 and len(table.inputFiles()) > 1
    assert flagged.count() == table.count() == rows
    assert flagged.filter("extreme != (z_max > 8) OR reason IS NULL").count() == 0


def test_merged_masks_hold_every_tree():
    """Looked up together or one by one, the masks lead each row to the leaf of its walk."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(500, 5)).round(1)
    grown = [anomalies._grow(values[rng.choice(500, 256, replace=False)], np.random.default_rng(t), 8) for t in range(5)]
    nodes = pd.concat([pd.DataFrame(n, columns=["node", "feature", "cut", "left", "right", "path"]).assign(tree=t) for t, n in enumerate(grown)])
    trees, _ = forest = anomalies.leaf_masks(nodes, 5)
    assert any(len(parts) > 1 for _, groups in trees for parts, _ in groups)
    walked = np.zeros(len(values))
    for tree in grown:
        tree = {n[0]: n for n in tree}
        for i, row in enumerate(values):
            at = tree[0]
            while at[1] >= 0:
                at = tree[at[3] if row[at[1]] <= at[2] else at[4]]
            walked[i] += at[5]
    assert np.allclose(anomalies.mean_path(forest, values), walked / len(grown))


def test_spread_is_only_taken_of_flat_columns(spark, monkeypatch):
    """A column with a typical deviation needs no further pass; one of mostly equal values falls back on its spread."""
    rows = [(float(i % 41), 5.0 if i else 900.0) for i in range(200)]
    asked = []
    taken = anomalies.fused_agg
    monkeypatch.setattr(anomalies, "fused_agg", lambda df, exprs: asked.append(len(exprs)) or taken(df, exprs))
    df = spark.createDataFrame(rows, "even double, flat double")
    found = anomalies.robust_z(df, ["even", "flat"]).orderBy(F.desc("z_max")).first()
    assert asked == [1]
    assert found["extreme"] and found["reason"].startswith("flat")
    assert np.isclose(found["z_max"], 895 / np.std([r[1] for r in rows], ddof=1))


def test_first_bit_in_several_words():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 256, 500)
    words = [np.where(bits // 64 == w, np.uint64(1) << (bits % 64).astype(np.uint64), np.uint64(0)) for w in range(4)]
    above = [w | np.where(bits // 64 < k, np.uint64(2**64 - 1), np.uint64(0)) for k, w in enumerate(words)]
    assert (anomalies._first_bit(words) == bits).all() and (anomalies._first_bit(above) == bits).all()


def test_quantiles_of_small_groups_take_no_sketch(spark, monkeypatch):
    """Only groups too large to sort as arrays are bracketed; both ways give the exact quantiles of every group."""
    from factloom.operators import order

    rng = np.random.default_rng(6)
    keys = np.concatenate([np.full(order.KEEP_ALL_ROWS + 9_000, -1), rng.integers(0, 300, 3_000)])
    pdf = pd.DataFrame({"k": keys, "x": rng.normal(size=len(keys)).round(3), "y": rng.uniform(size=len(keys))})
    pdf.loc[rng.integers(0, len(pdf), 500), "x"] = np.nan
    pdf.loc[pdf["k"] == 7, "y"] = np.nan
    seen = []
    bracketed = order._brackets
    monkeypatch.setattr(order, "_brackets", lambda data, *rest: seen.append(data.count()) or bracketed(data, *rest))
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    pdf["k"] = pdf["k"].where(pdf["k"] != 3)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = {(r["k"], r["column"]): r for r in order.exact_quantiles(df, ["x", "y"], probs, by=["k"]).collect()}
    assert seen == [order.KEEP_ALL_ROWS + 9_000]
    wanted = 0
    for key, part in pdf.groupby("k", dropna=False):
        for c in ("x", "y"):
            values = part[c].dropna()
            if len(values):
                row = found[None if pd.isna(key) else key, c]
                assert row["n"] == len(values)
                assert np.allclose([row[p] for p in probs], values.quantile(list(probs.values())))
                wanted += 1
    assert len(found) == wanted and (7, "y") not in found
