"""Tail functions against textbook values; order statistics and ranks against pandas and brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import tails
from factloom.operators import order


@pytest.mark.parametrize(
    "value, expected",
    [
        (tails.normal_sf(1.959963985), 0.025),
        (tails.chi2_sf(3.841458821, 1), 0.05),
        (tails.chi2_sf(18.30703805, 10), 0.05),
        (tails.chi2_sf(0.5, 3), 0.9188914),
        (tails.t_two_sided(2.228138852, 10), 0.05),
        (tails.t_two_sided(1.0, 1), 0.5),
        (tails.f_sf(4.102821, 2, 10), 0.05),
        (tails.f_sf(1.0, 5, 5), 0.5),
        (tails.t_critical(10), 2.228138852),
        (tails.t_critical(1e7), 1.959964),
    ],
)
def test_tails(value, expected):
    assert value == pytest.approx(expected, rel=1e-5)


def test_exact_u_matches_enumeration():
    n1, n2 = 3, 4
    stats = []
    for pick in itertools.combinations(range(n1 + n2), n1):
        stats.append(sum(sum(1 for j in range(n1 + n2) if j not in pick and j < i) for i in pick))
    for u in range(6, n1 * n2 + 1):
        tail = sum(s >= u for s in stats) / len(stats)
        assert tails.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * tail))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest is spread."""
    rng = np.random.default_rng(3)
    n = 9000
    values = np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 100, n).round(2))
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": values})
    pdf.loc[::50, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("per_bucket", [100_000, 50])
@pytest.mark.parametrize("parts", [1, 16])
def test_rank_sums(monkeypatch, skewed, per_bucket, parts):
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", per_bucket)
    pdf, df = skewed
    data = df.repartition(parts).withColumn("v", F.nanvl("v", F.lit(None)))
    found = {r["g"]: r for r in order.rank_sums(data, "v", "g").collect()}
    kept = pdf.dropna()
    expected = kept.assign(r=kept["v"].rank()).groupby("g")["r"].sum()
    ties = kept["v"].value_counts()
    for g, total in expected.items():
        assert found[g]["rank_sum"] == pytest.approx(total)
        assert found[g]["tie_term"] == pytest.approx(float((ties**3 - ties).sum()))


@pytest.mark.parametrize("keep_all", [40_000, 0])
def test_quantiles(monkeypatch, skewed, keep_all):
    monkeypatch.setattr(order, "KEEP_ALL_ROWS", keep_all)
    # A coarse bracket on few rows still has to hold the neighbours of each quantile.
    monkeypatch.setattr(order, "BRACKET", 0.01)
    pdf, df = skewed
    probs = {"lo": 0.005, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 0.995, "top": 1.0, "bottom": 0.0}
    row = order.exact_quantiles(df, ["v"], probs).first()
    for label, p in probs.items():
        assert row[label] == pytest.approx(pdf["v"].quantile(p))
    by = {r["g"]: r for r in order.exact_quantiles(df, ["v"], probs, by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for label, p in probs.items():
            assert by[g][label] == pytest.approx(part["v"].quantile(p))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_of_a_heavy_tail_in_ranges(spark, monkeypatch, by):
    """Brackets whose values crowd at one end: the ranges stay bounded and the quantiles exact."""
    monkeypatch.setattr(order, "KEEP_ALL_ROWS", 0)
    monkeypatch.setattr(order, "BRACKET", 0.2)
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", 100)
    sizes = []
    cut = order.range_slots

    def watched(values, keys):
        out = cut(values, keys)
        sizes.extend(r["count"] for r in out.groupBy("_slot").count().collect())
        return out

    monkeypatch.setattr(order, "range_slots", watched)
    v = np.exp(np.random.default_rng(8).normal(0, 12, 6000))
    pdf = pd.DataFrame({"g": np.where(np.arange(6000) % 3, "a", None), "v": v})
    df = spark.createDataFrame([(None if g is None else str(g), float(x)) for g, x in pdf.itertuples(index=False)], "g string, v double")
    probs = {"q1": 0.3, "q2": 0.5, "q3": 0.77}
    found = {r["g"] if by else "all": r for r in order.exact_quantiles(df, ["v"], probs, by=by).collect()}
    parts = {g: p["v"] for g, p in pdf.groupby("g", dropna=False)} if by else {"all": pdf["v"]}
    for g, part in parts.items():
        row = found[None if pd.isna(g) else g]
        assert all(row[label] == pytest.approx(part.quantile(p)) for label, p in probs.items())
    assert len(sizes) > 20 and max(sizes) <= 300


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert order.column_quantiles(df, ["v"], {"m": 0.5}) == {}


@pytest.mark.parametrize("per_bucket", [100_000, 100])
def test_prefix_totals(monkeypatch, skewed, per_bucket):
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", per_bucket)
    pdf, df = skewed
    counts = df.filter("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    found = {r["v"]: r["cum_n"] for r in order.ordered_prefix(counts, "v", ["n"], descending=True).collect()}
    expected = pdf.dropna()["v"].value_counts().sort_index(ascending=False).cumsum()
    assert found == {v: int(n) for v, n in expected.items()}


def test_top_share(skewed):
    pdf, df = skewed
    found = order.top_share(df.withColumn("v", F.nanvl("v", F.lit(None))), "v", 0.2).first()
    take = int(len(pdf) * 0.2)
    assert found["top_rows"] == take
    assert found["top_total"] == pytest.approx(pdf["v"].sort_values(ascending=False).head(take).sum())
