"""Queries over the experiment tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import abtest as A
from factloom.plans.registry import query, r, rounded, table

_GROUP_MOMENTS = "SELECT {g} AS g, count({m}) AS n, avg({m}) AS m, var_samp({m}) AS v FROM lineitem GROUP BY 1"


def _p_normal_two_sided(z: str) -> str:
    """Two-sided normal tail by Simpson's rule over 12 deviations."""
    return f"""(SELECT 2 * sum(exp(-x * x / 2) / sqrt(2 * pi()) * w) * 0.003 / 3 FROM (SELECT {z} + i * 0.003 AS x,
      CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001) t(i)))"""


@query(
    "A1 A2 A3",
    f"""WITH g AS (SELECT o_orderpriority = '1-URGENT' AS urgent, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS x FROM orders GROUP BY 1),
    w AS (SELECT max(n) FILTER (NOT urgent) AS n1, max(x) FILTER (NOT urgent) AS x1, max(n) FILTER (urgent) AS n2, max(x) FILTER (urgent) AS x2 FROM g),
    p AS (SELECT *, x1 / n1 AS p1, x2 / n2 AS p2, (x1 + x2) / (n1 + n2) AS pp FROM w),
    s AS (SELECT *, (p2 - p1) * (p2 - p1) / (pp * (1 - pp) * (1 / n1 + 1 / n2)) AS chi2, p2 - p1 AS diff,
      sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS se FROM p)
    SELECT 'binary' AS metric_type, 'Two-proportion Z-test / Chi-square' AS test_type, round(chi2, 6) AS statistic,
    round({_p_normal_two_sided("sqrt(chi2)")}, 4) AS p_value, {_p_normal_two_sided("sqrt(chi2)")} < 0.05 AS significant,
    round(diff / p1 * 100, 2) AS lift_pct, round(diff - 1.96 * se, 4) AS ci_low, round(diff + 1.96 * se, 4) AS ci_high, n1 + n2 AS row_count FROM s""",
)
def ab_two_proportions(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("normal").alias("arm"),
        (F.col("o_orderstatus") == "F").alias("done"),
    )
    test = A.ab_test(orders, "arm", "done", control="normal")
    return test.select(
        "metric_type", "test_type", r("statistic", 6), "p_value", "significant", "lift_pct", "ci_low", "ci_high",
        F.col("rows").alias("row_count"),
    )


@query(
    "A2 A4",
    """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS x FROM orders GROUP BY 1),
    t AS (SELECT sum(n) AS n, sum(x) AS x, count(*) AS k FROM g)
    SELECT t.k AS groups, CAST(t.n AS BIGINT) AS row_count, round(sum(pow(g.x - g.n * t.x / t.n, 2) / (g.n * t.x / t.n) + pow((g.n - g.x) - g.n * (t.n - t.x) / t.n, 2) / (g.n * (t.n - t.x) / t.n)), 6) AS chi2,
    t.k - 1 AS dof, round(sqrt(sum(pow(g.x - g.n * t.x / t.n, 2) / (g.n * t.x / t.n) + pow((g.n - g.x) - g.n * (t.n - t.x) / t.n, 2) / (g.n * (t.n - t.x) / t.n)) / (t.n * (t.k - 1))), 6) AS cramers_v,
    round(min(g.x / g.n), 6) AS min_rate, round(max(g.x / g.n), 6) AS max_rate FROM g, t GROUP BY t.k, t.n, t.x""",
)
def ab_chi_square(spark, sf):
    orders = table(spark, sf, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    found = A.chi_square(A.proportions(orders, "o_orderpriority", "done"))
    return rounded(
        found.select("groups", F.col("rows").alias("row_count"), "chi2", "dof", "cramers_v", "min_rate", "max_rate"), 6
    )


@query(
    "A5 G2",
    f"""WITH s AS ({_GROUP_MOMENTS.format(g="l_linestatus", m="l_extendedprice")}),
    w AS (SELECT max(n) FILTER (g = 'F') AS n1, max(m) FILTER (g = 'F') AS m1, max(v) FILTER (g = 'F') AS v1,
      max(n) FILTER (g = 'O') AS n2, max(m) FILTER (g = 'O') AS m2, max(v) FILTER (g = 'O') AS v2 FROM s)
    SELECT n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(m2 - m1, 4) AS diff, round(sqrt(v1 / n1 + v2 / n2), 4) AS se,
    round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
    round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS dof,
    round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round((m2 - m1) / abs(m1) * 100, 6) AS lift_pct FROM w""",
)
def ab_welch(spark, sf):
    data = A.numeric_metric(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")
    row = A.welch(A.moments(data), "F", "O")
    return row.select(
        "n1", "n2", r("mean1"), r("mean2"), r("diff"), r("se"), r("t", 6), r("dof", 3), r("cohens_d", 6), r("lift_pct", 6)
    )


@query(
    "A6 G10",
    """WITH k AS (SELECT l_linestatus AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem),
    t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY v)),
    w AS (SELECT count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2, sum(r) FILTER (g = 'O') AS r2 FROM k)
    SELECT n1, n2, round(r2 - n2 * (n2 + 1) / 2, 2) AS u, n1 * n2 / 2 AS u_mean,
    round(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))), 4) AS u_std, t = 0 AS no_ties FROM w, t""",
)
def ab_mann_whitney(spark, sf):
    data = A.numeric_metric(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity")
    found = A.mann_whitney(data, "F", "O")
    return found.select("n1", "n2", r("u", 2), "u_mean", r("u_std"), "no_ties")


@query(
    "A7",
    f"""WITH s AS ({_GROUP_MOMENTS.format(g="l_returnflag", m="l_extendedprice")}), t AS (SELECT avg(l_extendedprice) AS m FROM lineitem),
    b AS (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(s.m - t.m, 2)) AS ssb, sum((n - 1) * v) AS ssw, min(s.m) AS a, max(s.m) AS z FROM s, t)
    SELECT k AS groups, CAST(n AS BIGINT) AS row_count, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f,
    round(ssb / (ssb + ssw), 8) AS eta_squared, round(a, 4) AS min_mean, round(z, 4) AS max_mean FROM b""",
)
def ab_anova(spark, sf):
    data = A.numeric_metric(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    row = A.anova(A.moments(data))
    return row.select(
        "groups", F.col("rows").alias("row_count"), "df_between", "df_within", r("f", 6), r("eta_squared", 8), r("min_mean"), r("max_mean")
    )


@query(
    "A8 G10",
    """WITH k AS (SELECT l_returnflag AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem),
    t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY v)),
    s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS r FROM k GROUP BY g), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM k)
    SELECT count(*) AS groups, CAST(max(n.n) AS BIGINT) AS row_count, count(*) - 1 AS dof,
    round((12 / (max(n.n) * (max(n.n) + 1)) * sum(s.r * s.r / s.n) - 3 * (max(n.n) + 1)) / (1 - max(t.t) / (pow(max(n.n), 3) - max(n.n))), 4) AS h FROM s, t, n""",
)
def ab_kruskal(spark, sf):
    data = A.numeric_metric(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return A.kruskal(data).select("groups", F.col("rows").alias("row_count"), "dof", r("h"))


@query(
    "A9",
    f"""WITH s AS ({_GROUP_MOMENTS.format(g="l_linestatus", m="l_quantity")}),
    w AS (SELECT max(n) FILTER (g = 'O') AS n1, max(m) FILTER (g = 'O') AS m1, max(v) FILTER (g = 'O') AS v1,
      max(n) FILTER (g = 'F') AS n2, max(m) FILTER (g = 'F') AS m2, max(v) FILTER (g = 'F') AS v2 FROM s)
    SELECT round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t,
    n1 + n2 - 2 AS dof FROM w""",
)
def ab_student(spark, sf):
    return rounded(A.student_t(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity", "O", "F"), 6)


@query(
    "A10",
    f"""WITH s AS (SELECT l_discount AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
    t AS (SELECT avg(l_quantity) AS m FROM lineitem), b AS (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(s.m - t.m, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM s, t)
    SELECT 'l_discount' AS group_column, 'ANOVA / Kruskal-Wallis' AS test_type, k AS groups, CAST(n AS BIGINT) AS row_count,
    round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, round(ssb / (ssb + ssw), 4) AS effect_size FROM b""",
)
def ab_autopick(spark, sf):
    found = A.ab_autopick(table(spark, sf, "lineitem"), "l_quantity")
    return found.select("group_column", "test_type", "groups", F.col("rows").alias("row_count"), r("statistic", 6), "effect_size")


_GROUPS = ("l_returnflag", "l_linestatus", "l_linenumber")
_METRICS = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "A7",
    " UNION ALL ".join(
        f"""SELECT '{g}' AS group_column, '{m}' AS metric, k AS groups, CAST(n AS BIGINT) AS row_count, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f,
        round(ssb / (ssb + ssw), 8) AS eta_squared FROM (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(s.m - t.m, 2)) AS ssb, sum((n - 1) * v) AS ssw
        FROM ({_GROUP_MOMENTS.format(g=g, m=m)}) s, (SELECT avg({m}) AS m FROM lineitem) t)"""
        for g in _GROUPS
        for m in _METRICS
    ),
)
def ab_matrix(spark, sf):
    found = A.ab_matrix(table(spark, sf, "lineitem"), _GROUPS, _METRICS)
    return found.select("group_column", "metric", "groups", F.col("rows").alias("row_count"), r("f", 6), r("eta_squared", 8))


@query("A3 A4 A5 A6 A7 A8 A11")
def ab_reports(spark, sf):
    """The full result rows of each test family."""
    lines = table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    tests = {
        "proportions": A.ab_test(lines, "l_linestatus", "returned"),
        "independence": A.ab_test(lines, "l_linenumber", "returned"),
        "means": A.ab_test(lines, "l_linestatus", "l_extendedprice"),
        "many means": A.ab_test(lines, "l_returnflag", "l_extendedprice"),
        "two tables": A.ab_test_frames(lines.filter("l_discount <= 0.05"), lines.filter("l_discount > 0.05"), "l_quantity"),
    }
    return reduce(DataFrame.unionByName, [t.withColumn("test", F.lit(n)) for n, t in tests.items()])


@query(
    "A1 A2",
    """SELECT 'l_linestatus' AS metric, true AS binary, count(*) FILTER (l_linestatus = 'O') AS successes FROM lineitem
    UNION ALL SELECT 'l_returnflag', false, NULL UNION ALL SELECT 'returned', true, count(*) FILTER (l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 'flag', true, count(*) FILTER (l_tax > 0.04) FROM lineitem UNION ALL SELECT 'answer', true, count(*) FILTER (l_tax <= 0.04) FROM lineitem
    UNION ALL SELECT 'l_quantity', false, NULL""",
)
def binary_metrics(spark, sf):
    """Success counts; 'Yes' is no known label by case, so the last text, 'no', is the success."""
    high = F.col("l_tax") > 0.04
    lines = table(spark, sf, "lineitem").select(
        "l_linestatus", "l_returnflag", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"),
        high.cast("int").alias("flag"), F.when(high, "Yes").otherwise("no").alias("answer"),
    )
    rows = []
    for metric in ("l_linestatus", "l_returnflag", "returned", "flag", "answer", "l_quantity"):
        binary = A.is_binary_metric(lines, metric)
        total = lines.agg(F.sum(A.success_flag(lines, metric)).alias("s")).first()["s"] if binary else None
        rows.append((metric, binary, total))
    return spark.createDataFrame(rows, "metric string, binary boolean, successes bigint")
