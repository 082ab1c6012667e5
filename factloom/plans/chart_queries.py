"""Queries over chart data, joins, group statistics, windows and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import charts as C
from factloom.operators import groups as G
from factloom.operators import segments as S
from factloom.operators.features import align_features, mapped, risk_tier
from factloom.operators.forecast import calendar_fill, interpolate
from factloom.operators.order import average_ranks, exact_quantiles, rank_sums, top_share
from factloom.plans.registry import query, r, rounded, table

_HIST = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _hist_sql(source: str, column: str, split: str | None = None) -> str:
    """Thirty equal bins with edges checked, empty bins kept."""
    keep = f"{split}, " if split else ""
    return f"""SELECT '{column}' AS "column", {keep}b.bin, round(lo + b.bin * (hi - lo) / 30, 6) AS lower,
    round(CASE WHEN b.bin = 29 THEN hi ELSE lo + (b.bin + 1) * (hi - lo) / 30 END, 6) AS upper, coalesce(n, 0) AS n
    FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(30) t(i)) b
    CROSS JOIN (SELECT min({column}) AS lo, max({column}) AS hi FROM {source})
    {f"CROSS JOIN (SELECT DISTINCT {split} FROM {source})" if split else ""}
    LEFT JOIN (SELECT {keep}raw - CASE WHEN x < lo + raw * st THEN 1 ELSE 0 END + CASE WHEN x >= lo + (raw + 1) * st AND raw < 29 THEN 1 ELSE 0 END AS bin, count(*) AS n
      FROM (SELECT {keep}x, lo, (hi - lo) / 30 AS st, least(floor((x - lo) / (hi - lo) * 30), 29) AS raw
        FROM (SELECT {keep}{column} AS x, (SELECT min({column}) FROM {source}) AS lo, (SELECT max({column}) FROM {source}) AS hi FROM {source}))
      GROUP BY ALL) c USING ({keep}bin)"""


@query("E1", " UNION ALL ".join(_hist_sql("lineitem", c) for c in _HIST))
def histograms(spark, sf):
    return rounded(C.histograms(table(spark, sf, "lineitem"), _HIST), 6)


@query("E11", _hist_sql("lineitem", "l_quantity", "l_linestatus"))
def histogram_overlay(spark, sf):
    return rounded(C.histograms(table(spark, sf, "lineitem"), ["l_quantity"], split_by="l_linestatus"), 6)


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(
    "E2",
    " UNION ALL ".join(f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", round(corr({a}, {b}), 6) AS r FROM lineitem' for a, b in _PAIRS),
)
def correlation_pairs(spark, sf):
    return rounded(C.correlations(table(spark, sf, "lineitem"), _CORR), 6)


@query(
    "E2 E6",
    """WITH d AS (SELECT o_totalprice AS price, o_totalprice * 0.1 + o_custkey AS fee, o_custkey AS cust, -o_totalprice AS refund FROM orders)
    SELECT * FROM (SELECT 'price' AS "left", 'fee' AS "right", round(corr(price, fee), 6) AS r FROM d
      UNION ALL SELECT 'price', 'cust', round(corr(price, cust), 6) FROM d UNION ALL SELECT 'price', 'refund', round(corr(price, refund), 6) FROM d
      UNION ALL SELECT 'fee', 'cust', round(corr(fee, cust), 6) FROM d UNION ALL SELECT 'fee', 'refund', round(corr(fee, refund), 6) FROM d
      UNION ALL SELECT 'cust', 'refund', round(corr(cust, refund), 6) FROM d)
    WHERE abs(r) > 0.5 ORDER BY abs(r) DESC, "left" DESC, "right" DESC LIMIT 2""",
)
def strong_correlations(spark, sf):
    price = F.col("o_totalprice")
    data = table(spark, sf, "orders").select(
        price.alias("price"), (price * 0.1 + F.col("o_custkey")).alias("fee"), F.col("o_custkey").alias("cust"), (-price).alias("refund")
    )
    return rounded(C.strong_pairs(data, ["price", "fee", "cust", "refund"]), 6)


@query(
    "E3 I7",
    "SELECT o_orderstatus AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, count(*) AS n FROM orders GROUP BY 1",
)
def target_counts(spark, sf):
    return C.target_distribution(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "E3 E1",
    'SELECT CAST(bin AS VARCHAR) AS value, lower, upper, n FROM (' + _hist_sql("orders", "o_totalprice") + ")",
)
def target_histogram(spark, sf):
    return rounded(C.target_distribution(table(spark, sf, "orders"), "o_totalprice"), 6)


@query(
    "E4",
    """SELECT 'l_returnflag' AS "column", l_returnflag AS value, round(avg(CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 0.0 END), 4) AS rate,
    count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def category_rates(spark, sf):
    return rounded(C.category_rates(table(spark, sf, "lineitem"), "l_linestatus"))


_BOXES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "E5",
    " UNION ALL ".join(
        f"""SELECT l_returnflag AS target_value, '{c}' AS "column", n, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
        round(min(x) FILTER (x >= q1 - (q3 - q1) * 1.5), 4) AS whisker_low, round(max(x) FILTER (x <= q3 + (q3 - q1) * 1.5), 4) AS whisker_high
        FROM (SELECT l_returnflag, {c} AS x FROM lineitem) JOIN (SELECT l_returnflag, count({c}) AS n, quantile_cont({c}, 0.25) AS q1,
          quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY ALL"""
        for c in _BOXES
    ),
)
def box_stats(spark, sf):
    return rounded(C.box_stats(table(spark, sf, "lineitem"), "l_returnflag", _BOXES))


@query(
    "E7 J6",
    """WITH d AS (SELECT o_totalprice AS y, o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
      dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders)
    SELECT 'o_orderkey' AS "column", round(corr(y, o_orderkey), 6) AS r FROM d UNION ALL SELECT 'o_custkey', round(corr(y, o_custkey), 6) FROM d
    UNION ALL SELECT 'o_orderstatus', round(corr(y, o_orderstatus), 6) FROM d UNION ALL SELECT 'o_orderpriority', round(corr(y, o_orderpriority), 6) FROM d""",
)
def target_correlations(spark, sf):
    return rounded(C.target_correlations(table(spark, sf, "orders"), "o_totalprice"), 6)


_QUANTITY_SEGMENT = """CASE WHEN l_quantity <= e[2] THEN format('{:.4g}', e[1]) || ' to ' || format('{:.4g}', e[2])
  WHEN l_quantity <= e[3] THEN format('{:.4g}', e[2]) || ' to ' || format('{:.4g}', e[3])
  WHEN l_quantity <= e[4] THEN format('{:.4g}', e[3]) || ' to ' || format('{:.4g}', e[4])
  ELSE format('{:.4g}', e[4]) || ' to ' || format('{:.4g}', e[5]) END"""
_EDGES = "SELECT quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) AS e FROM lineitem"


@query(
    "E8 F2",
    f"""SELECT {_QUANTITY_SEGMENT} AS segment, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n
    FROM lineitem, ({_EDGES}) GROUP BY 1""",
)
def segment_rates(spark, sf):
    return rounded(C.segment_rates(table(spark, sf, "lineitem"), "l_returnflag", "R", "l_quantity"), 6)


@query(
    "F2",
    f"SELECT {_QUANTITY_SEGMENT} AS segment, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem, ({_EDGES}) GROUP BY 1",
)
def quartile_segments(spark, sf):
    return S.quartile_segments(table(spark, sf, "lineitem"), "l_quantity")


@query(
    "F3",
    f"""WITH e AS ({_EDGES}), t AS (SELECT count(*) AS n, avg(l_extendedprice) AS y FROM lineitem), s AS (
      SELECT 'l_quantity' AS "column", {_QUANTITY_SEGMENT} AS segment, l_extendedprice AS y, 0.4 AS importance FROM lineitem, e
      UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_extendedprice, 0.3 FROM lineitem
      UNION ALL SELECT 'l_returnflag', l_returnflag, l_extendedprice, 0.2 FROM lineitem
      UNION ALL SELECT 'l_linestatus', l_linestatus, l_extendedprice, 0.1 FROM lineitem)
    SELECT "column", segment, count(*) AS n, round(count(*) / t.n, 6) AS share, round(avg(s.y), 4) AS value, round(avg(s.y) / t.y, 6) AS lift,
      CAST(importance AS DOUBLE) AS importance, round(t.y, 4) AS overall FROM s, t GROUP BY "column", segment, importance, t.n, t.y
      HAVING count(*) >= greatest(30, floor(0.02 * t.n))""",
)
def driver_segments(spark, sf):
    weights = {"l_quantity": 0.4, "l_linenumber": 0.3, "l_returnflag": 0.2, "l_linestatus": 0.1}
    found = S.driver_segments(table(spark, sf, "lineitem"), weights, F.col("l_extendedprice"))
    return found.select("column", "segment", "n", r("share", 6), r("value"), r("lift", 6), "importance", r("overall"))


@query("F3 F5")
def driver_findings(spark, sf):
    """Picks among customer segments by how often an order is large."""
    orders = table(spark, sf, "orders").withColumn("weekday", F.weekday("o_orderdate"))
    weights = {"o_custkey": 0.5, "o_orderpriority": 0.3, "weekday": 0.2, "o_totalprice": 0.9}
    large = (F.col("o_totalprice") > 300_000).cast("double")
    return S.segment_findings(S.driver_segments(orders, weights, large))


@query(
    "E9 G9",
    """SELECT score, CAST(sum(n) OVER w AS BIGINT) AS contacted, round(sum(n) OVER w / (SELECT count(*) FROM orders), 8) AS share_contacted,
    round(sum(h) OVER w / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 8) AS share_captured
    FROM (SELECT o_totalprice AS score, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS h FROM orders GROUP BY 1) WINDOW w AS (ORDER BY score DESC)""",
)
def gains_curve(spark, sf):
    orders = table(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(C.gains_curve(orders, "o_totalprice", "hit"), 8)


@query(
    "F4",
    """WITH o AS (SELECT o_totalprice AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS h FROM orders),
    k AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.1)) AS k, sum(h) AS p FROM o),
    g AS (SELECT s, count(*) AS c, sum(h) AS h, sum(count(*)) OVER (ORDER BY s DESC) AS cum FROM o GROUP BY s)
    SELECT n AS row_count, CAST(p AS BIGINT) AS positives, round(p / n, 6) AS base_rate, CAST(k AS BIGINT) AS top_rows,
    round(sum(g.h * greatest(0, least(c, k - (cum - c))) / c) / p, 6) AS top_capture,
    round(sum(g.h * greatest(0, least(c, k - (cum - c))) / c) / p / 0.1, 6) AS top_lift FROM g, k GROUP BY n, p, k""",
)
def top_decile_capture(spark, sf):
    orders = table(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(S.top_capture(orders, "o_totalprice", "hit"), 6)


@query(
    "G5",
    """WITH k AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM orders)
    SELECT n AS row_count, k AS top_rows, round(sum(o_totalprice) FILTER (rn <= k) / sum(o_totalprice), 6) AS top_share
    FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS rn FROM orders), k GROUP BY n, k""",
)
def pareto_top20(spark, sf):
    found = top_share(table(spark, sf, "orders"), "o_totalprice", 0.2)
    return found.select(F.col("rows").alias("row_count"), "top_rows", r("top_share", 6))


@query(
    "E10 P3",
    """SELECT position, tier, count(o_orderkey) AS n FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low')) v(position, tier)
    LEFT JOIN (SELECT o_orderkey, CASE WHEN o_totalprice / 500000 < 0.35 THEN 'Low' WHEN o_totalprice / 500000 < 0.7 THEN 'Medium' ELSE 'High' END AS tier FROM orders) USING (tier) GROUP BY ALL""",
)
def risk_tier_counts(spark, sf):
    scored = table(spark, sf, "orders").withColumn("tier", risk_tier(F.col("o_totalprice") / 500_000))
    return C.tier_counts(scored, "tier")


@query(
    "G2",
    """SELECT l_returnflag AS "group", count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
    round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1""",
)
def group_stats(spark, sf):
    return rounded(G.group_stats(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@query(
    "G3",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT count(*) AS levels, CAST(sum(n) AS BIGINT) AS row_count, round(sum(best) / sum(n), 6) AS purity,
    round((SELECT max(s) FROM (SELECT sum(n) AS s FROM c GROUP BY b)) / sum(n), 6) AS base_share
    FROM (SELECT a, max(n) AS best, sum(n) AS n FROM c GROUP BY a)""",
)
def crosstab_purity(spark, sf):
    return rounded(G.crosstab_purity(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), 6)


@query(
    "G4",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(quantile_cont({c}, 0.005), 3) AS p005, round(quantile_cont({c}, 0.5), 3) AS p500,
        round(quantile_cont({c}, 0.9), 3) AS p900, round(quantile_cont({c}, 0.995), 3) AS p995 FROM lineitem"""
        for c in ("l_extendedprice", "l_discount")
    ),
)
def exact_quantile_table(spark, sf):
    probs = {"p005": 0.005, "p500": 0.5, "p900": 0.9, "p995": 0.995}
    return rounded(exact_quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_discount"], probs), 3)


@query(
    "G6 A11",
    """SELECT CASE WHEN l_discount <= 0.05 THEN 'Control (A)' ELSE 'Treatment (B)' END AS _ab_group, count(*) AS n,
    round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
)
def cohort_union(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_discount", "l_quantity")
    both = G.cohort_union(lines.filter("l_discount <= 0.05"), lines.filter("l_discount > 0.05"))
    return rounded(both.groupBy("_ab_group").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")), 6)


@query(
    "G7 C1",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def distinct_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()


@query("G8", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return G.top_k(orders, 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    "G10",
    """WITH k AS (SELECT l_quantity AS v, l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem)
    SELECT g AS l_returnflag, count(*) AS n, round(sum(r), 2) AS rank_sum, (SELECT count(*) FROM k) AS total_n,
    (SELECT CAST(sum(c * c * c - c) AS DOUBLE) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY v)) AS tie_term FROM k GROUP BY g""",
)
def tie_rank_sums(spark, sf):
    sums = rank_sums(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return sums.select("l_returnflag", "n", r("rank_sum", 2), "total_n", "tie_term")


@query(
    "G10",
    """SELECT p_size, count(*) AS n, CAST(min(r) AS DOUBLE) AS rank FROM
    (SELECT p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r FROM part) GROUP BY p_size""",
)
def average_rank_table(spark, sf):
    return average_ranks(table(spark, sf, "part"), "p_size").select("p_size", "n", "rank")


@query(
    "G11 J5",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS y FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
    f AS (SELECT c.day, y, row_number() OVER (ORDER BY c.day) AS pos FROM c LEFT JOIN d USING (day)),
    g AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS v0, first_value(y IGNORE NULLS) OVER a AS v1,
      max(CASE WHEN y IS NOT NULL THEN pos END) OVER b AS p0, min(CASE WHEN y IS NOT NULL THEN pos END) OVER a AS p1 FROM f
      WINDOW b AS (ORDER BY day ROWS UNBOUNDED PRECEDING), a AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(y, v0 + (v1 - v0) * (pos - p0) / (p1 - p0)), 6) AS y FROM g""",
)
def gap_interpolation(spark, sf):
    days = (
        table(spark, sf, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.avg("o_totalprice").alias("y"))
    )
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    full = ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left").withColumn("series", F.lit("all"))
    filled = interpolate(full, ["series"], "day", "y")
    return filled.select(F.date_format("day", "yyyy-MM-dd").alias("day"), r("y", 6))


@query(
    "J5",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS p, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS period, coalesce(n, 0) AS n FROM
    (SELECT CAST(unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN d ON p = day""",
)
def calendar_days(spark, sf):
    return calendar_fill(table(spark, sf, "orders"), "o_orderdate", "day").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")


@query(
    "G12",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS churned, round(avg(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END), 6) AS churn_rate,
    count(*) FILTER (o_totalprice > 300000) AS at_risk, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue,
    round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_totalprice > 300000) AS DOUBLE), 2) AS revenue_at_risk,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN months END), 6) AS avg_tenure_churned, round(avg(CASE WHEN o_orderstatus <> 'F' THEN months END), 6) AS avg_tenure_stayed
    FROM (SELECT *, date_diff('month', o_orderdate, TIMESTAMP '2001-12-01') AS months FROM orders)""",
)
def kpi_block(spark, sf):
    months = (F.lit(2001) - F.year("o_orderdate")) * 12 + F.lit(12) - F.month("o_orderdate")
    orders = table(spark, sf, "orders").withColumn("months", months)
    found = G.kpi_block(orders, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300_000, "o_totalprice", "months")
    return rounded(rounded(found, 6), 2, ("revenue", "revenue_at_risk"))


@query(
    "G12",
    """WITH d AS (SELECT o_orderpriority AS priority, CAST(o_totalprice > 250000 AS VARCHAR) AS large, CAST(year(o_orderdate) AS VARCHAR) AS year,
      CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END AS y FROM orders)
    SELECT 'priority' AS cohort, priority AS value, round(avg(y), 6) AS rate, count(*) AS n FROM d GROUP BY priority
    UNION ALL SELECT 'large', large, round(avg(y), 6), count(*) FROM d GROUP BY large UNION ALL SELECT 'year', year, round(avg(y), 6), count(*) FROM d GROUP BY year""",
)
def cohort_rates(spark, sf):
    cohorts = {"priority": F.col("o_orderpriority"), "large": F.col("o_totalprice") > 250_000, "year": F.year("o_orderdate")}
    return rounded(G.cohort_rates(table(spark, sf, "orders"), cohorts, F.col("o_orderstatus") == "F"), 6)


@query(
    "G13",
    """SELECT * FROM (SELECT p_brand AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1 ORDER BY importance DESC, feature LIMIT 12)""",
)
def importance_tail(spark, sf):
    weights = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("importance"))
    return G.importance_tail(weights)


_CODES = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}


@query(
    "J6",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END AS risk FROM orders""",
)
def value_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", mapped(F.col("o_orderpriority"), _CODES).alias("risk"))


@query("J7", "SELECT c_custkey, 0.0::DOUBLE AS tenure, c_acctbal, 0.0::DOUBLE AS services FROM customer")
def aligned_features(spark, sf):
    return align_features(table(spark, sf, "customer"), ["c_custkey", "tenure", "c_acctbal", "services"])
