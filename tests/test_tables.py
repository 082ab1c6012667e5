"""Inspection, cleaning, relevance and semantic kinds on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import subscribers
from pyspark.sql import functions as F

from factloom.operators import charts, clean, order, profile, relevance, semantic


def test_inspect_finds_outcome(small_normal):
    found = profile.inspect(small_normal, "churn")
    assert (found["rows"], found["columns"], found["target"], found["problem_type"]) == (60, 4, "Churn", "classification")
    assert found["kinds"] == {"tenure": "numerical", "MonthlyCharges": "numerical", "Contract": "categorical", "Churn": "categorical"}


def test_statistics_equal_pandas(spark):
    pdf = subscribers(200)
    pdf["constant"] = 3.0
    found = {r["column"]: r for r in profile.numeric_stats(spark.createDataFrame(pdf), digits=9).collect()}
    for c in ("tenure", "MonthlyCharges", "constant"):
        assert found[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=1e-8)
        assert found[c]["median"] == pytest.approx(pdf[c].median())
        assert found[c]["std"] == pytest.approx(pdf[c].std())


def test_id_needs_name_and_values(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "customer_id int, region_id int, amount double")
    assert profile.id_column_names(df, 30) == ["customer_id"]


def test_target_falls_to_last_small_column(spark):
    df = spark.createDataFrame([(i, i % 4, i % 2, f"t{i}") for i in range(40)], "a int, b int, c int, d string")
    assert profile.detect_target(df) == "c"
    assert profile.detect_target(df.withColumnRenamed("a", "Revenue"), "sales") == "Revenue"


def test_cleaning_fills_and_reports(nulls_and_duplicates):
    found = profile.inspect(nulls_and_duplicates)
    assert found["duplicates"] == 45 and found["missing_total"] == 30
    cleaned, plan = clean.clean(nulls_and_duplicates)
    rows = cleaned.collect()
    assert len(rows) == 5 and all(v is not None for r in rows for v in r)
    assert plan.steps[0] == "Removed 45 duplicate rows" and plan.nulls_remaining == 0
    assert "Filled 1 nulls in 'Contract' with mode ('Month-to-month')" in plan.steps


def test_cleaning_leaves_clean_data(small_normal):
    cleaned, plan = clean.clean(small_normal)
    assert cleaned.count() == small_normal.dropDuplicates().count()
    if plan.rows_before == plan.rows_after:
        assert plan.steps == ["Data was already clean — no changes needed!"]


def test_cleaning_coerces(spark):
    rows = [(f" {i} ", f"0{1 + i % 9}/15/2024", " x ", "n/a" if i % 10 == 0 else str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "a string, order_date string, c string, d string")
    cleaned, plan = clean.clean(df)
    assert [t for _, t in cleaned.dtypes] == ["double", "timestamp_ntz", "string", "double"]
    assert cleaned.filter("c <> 'x'").count() == 0
    assert plan.filled_nulls == {"d": 5}


def test_all_null_text_becomes_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert {r["b"] for r in clean.clean(df)[0].collect()} == {"Unknown"}


def test_row_order_and_partitions_do_not_matter(nulls_and_duplicates):
    one = sorted(map(tuple, clean.clean(nulls_and_duplicates.coalesce(1))[0].collect()))
    many = sorted(map(tuple, clean.clean(nulls_and_duplicates.repartition(16))[0].collect()))
    assert one == many


@pytest.mark.parametrize(
    "columns, verdict",
    [
        ({"Order_ID": "int", "Customer_Name": "text", "Sales": "money", "Profit": "money", "Discount": "unit", "Region": "text"}, "business"),
        ({"sepal_length": "unit", "sepal_width": "unit", "petal_length": "unit", "petal_width": "unit", "species": "text"}, "not_business"),
        ({"temp_c": "normal", "humidity": "unit", "wind_mph": "unit", "precipitation": "unit"}, "not_business"),
    ],
)
def test_relevance(spark, columns, verdict):
    rng = np.random.default_rng(1)
    make = {
        "int": lambda: np.arange(40), "text": lambda: rng.choice(list("abc"), 40), "money": lambda: rng.uniform(10, 900, 40),
        "unit": lambda: rng.uniform(0, 1, 40), "normal": lambda: rng.normal(0, 5, 40),
    }
    df = spark.createDataFrame(pd.DataFrame({c: make[k]() for c, k in columns.items()}))
    assert relevance.relevance(df, "t").first()["verdict"] == verdict


def test_semantic_kinds(spark):
    n = 100
    pdf = pd.DataFrame(
        {
            "user_id": np.arange(n), "day": [f"2024-01-{1 + i % 28:02d}" for i in range(n)], "flag": [i % 2 for i in range(n)],
            "grade": [i % 5 for i in range(n)], "amount": np.linspace(0, 9, n), "plan": [("a", "b", "c")[i % 3] for i in range(n)],
            "note": [f"this is a rather long remark about the order number {i}" for i in range(n)], "code": [f"K{i}" for i in range(n)],
        }
    )
    kinds = {r["column"]: r["kind"] for r in semantic.semantic_profile(spark.createDataFrame(pdf)).collect()}
    assert kinds == {
        "user_id": "id", "day": "datetime", "flag": "boolean", "grade": "categorical", "amount": "numeric",
        "plan": "categorical", "note": "text", "code": "id",
    }


def test_target_confidence(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}", "Yes" if i % 4 else "No") for i in range(60)], "tenure int, plan string, Churn string")
    _, info = semantic.profile(df, "churn")
    assert (info["target"], info["positive_label"], info["problem"]) == ("Churn", "Yes", "classification")
    assert info["confidence"] == 0.95 and info["plan"] == ["descriptive", "supervised", "anomalies"]


def test_histogram_equals_numpy(spark):
    values = np.round(np.random.default_rng(5).uniform(0, 0.1, 500), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    found = [r["n"] for r in charts.histograms(df, ["v"]).orderBy("bin").collect()]
    assert found == list(np.histogram(values, bins=30)[0])


def test_string_codes_follow_text_order(spark):
    words = [f"w{i * 7919 % 5000:04d}" for i in range(5000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = {r["value"]: r["code"] for r in charts.string_codes(df, "w").collect()}
    assert found == {w: float(i) for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("per_bucket", [100_000, 20])
def test_codes_of_several_columns(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": [f"w{i}" for i in rng.integers(0, 300, 900)], "b": rng.choice(["x", "y", None], 900), "c": ["one"] * 900})
    pdf["y"] = 1e9 + pdf["a"].str[1:].astype(int) + rng.normal(0, 50, 900)
    pdf.loc[::7, "y"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "a string, b string, c string, y double")
    found = {r["column"]: r["r"] for r in charts.target_correlations(df, "y").collect()}
    for c in ("a", "b"):
        codes = pdf[c].map({v: i for i, v in enumerate(sorted(pdf[c].dropna().unique()))}).fillna(-1)
        assert found[c] == pytest.approx(codes.corr(pdf["y"]))
    assert set(found) == {"a", "b", "c"} and found["c"] is None
    none = charts.target_correlations(df.withColumn("y", F.lit(None).cast("double")), "y").collect()
    assert len(none) == 3 and all(r["r"] is None for r in none)


def test_layout_shapes_lose_no_value(spark):
    texts = [
        "2024/01/05", "2024/1/5", "2024/01/05 10:11:12", "01/05/2024", "1/5/2024", "13/05/2024", "01-05-2024", "05-Jan-2024", "5 Jan 2024",
        "5 JAN 2024", "Jan 5, 2024", "Jan 05, 2024", "31/12/2024", "3/2/24", "007/05/2024", "+2024/01/05", "02/30/2024", "-", "", None, "x", "20240105",
        "2024/01/05 10:11", "01/05/2024 10:11", "01/05/2024 10:11:12", "  1/5/2024 ", "١/٥/٢٠٢٤", "10000/01/05", "May 5, 2024", "mai 5, 2024",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for layout in clean.DATE_LAYOUTS:
        plain = F.try_to_timestamp(F.trim("t"), F.lit(layout)).cast("timestamp_ntz")
        assert df.where(~clean.parse_layout(F.col("t"), layout).eqNullSafe(plain)).count() == 0, layout


def test_bounded_distinct_decides_like_exact_counts(spark):
    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("order_id"), (F.col("id") % 2400).alias("close_id"), (F.col("id") % 2401).alias("near_id"), (F.col("id") % 50).alias("few"),
        F.concat(F.lit("v"), F.col("id") % 51).alias("more"), F.lit(None).cast("string").alias("none"), F.array("id").alias("nested"),
    )
    exact = profile.exact_distinct(df, [c for c in df.columns if c != "nested"])
    found = profile.bounded_distinct(df, df.columns, ratios=[0.6], few=50)
    assert found["nested"] == found["none"] == 0
    assert {c: found[c] for c in ("close_id", "near_id", "few", "more")} == {c: exact[c] for c in ("close_id", "near_id", "few", "more")}
    assert profile.id_column_names(df, n) == ["order_id", "near_id"]
    kinds = [{r["column"]: r["kind"] for r in semantic.semantic_profile(df, {}, exact=e).collect()} for e in (True, False)]
    assert kinds[0] == kinds[1]


def test_clean_plan_applies_to_new_rows(spark, nulls_and_duplicates):
    _, plan = clean.clean(nulls_and_duplicates)
    new = spark.createDataFrame([(None, None, None, "No")], nulls_and_duplicates.schema)
    assert all(v is not None for v in clean.apply_plan(new, plan).first())


def test_duplicate_hashes_tell_shifted_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert profile.duplicate_summary(df) == {"rows": 2, "repeats": 0}
    assert profile.duplicate_summary(df.union(df)) == {"rows": 4, "repeats": 2}


def test_facts_of_a_table(small_normal):
    lines = {r["column"]: r["fact"] for r in profile.column_facts(small_normal).collect()}
    assert lines["tenure"].startswith("mean ") and lines["Churn"].endswith("(of 60 rows)")
    card = profile.fact_card(small_normal, "All", "Churn").first()
    assert card["numbers"].startswith("Rows: 60; Cols: 4; Missing: 0; Mode Churn: ")


def test_codes_survive_null(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 2.0), ("a", 3.0)], "t string, y double")
    found = charts.target_correlations(df, "y").first()
    codes = pd.Series([1.0, -1.0, 0.0])
    assert found["r"] == pytest.approx(codes.corr(pd.Series([1.0, 2.0, 3.0])))
