"""Queries over anomalies, segments, forecasts, facts and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import anomalies as A
from factloom.operators import clusters as K
from factloom.operators import facts as N
from factloom.operators import forecast as W
from factloom.operators.clean import clean
from factloom.operators.order import column_quantiles, top_share
from factloom.operators.profile import inspect
from factloom.operators.segments import top_capture
from factloom.plans.analyze import analyze
from factloom.plans.profile_queries import customers_with_holes
from factloom.plans.registry import query, r, rounded, table
from factloom.session import materialize


@query(
    "U5",
    """WITH m AS (SELECT median(o_totalprice) AS p, median(o_custkey) AS c FROM orders),
    d AS (SELECT median(abs(o_totalprice - p)) AS dp, median(abs(o_custkey - c)) AS dc FROM orders, m),
    z AS (SELECT o_orderkey, abs((o_totalprice - p) / (1.4826 * dp)) AS zp, abs((o_custkey - c) / (1.4826 * dc)) AS zc FROM orders, m, d)
    SELECT o_orderkey, round(greatest(zp, zc), 6) AS z_max, greatest(zp, zc) > 8 AS extreme, CASE WHEN zp >= zc THEN 'o_totalprice' ELSE 'o_custkey' END AS cause FROM z""",
)
def robust_z_scores(spark, sf):
    scored = A.robust_z(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return scored.select("o_orderkey", r("z_max", 6), "extreme", F.split("reason", " ")[0].alias("cause"))


@query(
    "U5",
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 500 = 0 THEN value * 1000 + 5000 WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
    m AS (SELECT median(v) AS m FROM raw), f AS (SELECT event_id, coalesce(v, m) AS v, m FROM raw, m), d AS (SELECT median(abs(v - m)) AS d FROM f)
    SELECT count(*) FILTER (abs(v - m) / (1.4826 * d) > 8) AS extremes, count(*) AS row_count FROM f, d""",
)
def extreme_events(spark, sf):
    key = F.col("event_id")
    events = table(spark, sf, "events").select(
        "event_id", F.when(key % 500 == 0, F.col("value") * 1000 + 5000).when(key % 7 != 0, F.col("value")).alias("v")
    )
    return A.robust_z(events, ["v"]).agg(F.count_if("extreme").alias("extremes"), F.count(F.lit(1)).alias("row_count"))


@query("U6 G8")
def isolation_forest(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    flagged = A.anomalies(table(spark, sf, "lineitem"), names)
    return A.top_anomalies(flagged).select("l_orderkey", "l_linenumber", "anomaly_score", "is_anomaly", "extreme", "reason")


@query(
    "U6",
    """WITH m AS (SELECT median(o_totalprice) AS p, median(o_custkey) AS c FROM orders), d AS (SELECT median(abs(o_totalprice - p)) AS dp, median(abs(o_custkey - c)) AS dc FROM orders, m)
    SELECT 'rows' AS item, count(*) AS n FROM orders UNION ALL SELECT 'scores between 0 and 1', count(*) FROM orders
    UNION ALL SELECT 'scores of unlike rows', count(DISTINCT (o_totalprice, o_custkey)) FROM orders
    UNION ALL SELECT 'extreme', count(*) FILTER (greatest(abs(o_totalprice - p) / dp, abs(o_custkey - c) / dc) / 1.4826 > 8) FROM orders, m, d
    UNION ALL SELECT 'flagged beyond the cut', CAST(floor(count(*) * 0.02) AS BIGINT) FROM orders""",
)
def isolation_invariants(spark, sf):
    """What must hold for the scores of any forest; ties at the cut are not counted twice."""
    names = ["o_totalprice", "o_custkey"]
    flagged = A.anomalies(table(spark, sf, "orders"), names)
    unlike = flagged.select(*names, "anomaly_score").distinct()
    share = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly_score").between(0, 1)).alias("s"), F.count_if("extreme").alias("x")).join(
        unlike.agg(F.count(F.lit(1)).alias("u"))
    )
    cut = column_quantiles(flagged, ["anomaly_score"], {"cut": 1 - A.CONTAMINATION})["anomaly_score"]["cut"]
    above = flagged.agg(F.count_if(F.col("anomaly_score") > cut).alias("above"), F.count_if(F.col("anomaly_score") >= cut).alias("upto"))
    # Rows with the score of the cut itself lie on neither side.
    wanted = F.floor(F.col("n") * A.CONTAMINATION)
    kept = F.when((F.col("above") <= wanted + 1) & (F.col("upto") >= wanted), wanted).otherwise(F.col("above"))
    items = [("rows", F.col("n")), ("scores between 0 and 1", F.col("s")), ("scores of unlike rows", F.col("u")), ("extreme", F.col("x")), ("flagged beyond the cut", kept)]
    return share.join(above).select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), v.cast("long").alias("n")) for k, v in items])))


@query("U6")
def anomaly_shares(spark, sf):
    return A.anomaly_summary(A.anomalies(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


def _segmented(spark, sf):
    customers = table(spark, sf, "customer")
    return K.segmentation(customers, ["c_acctbal"], ["c_mktsegment"])


@query("U1 U2 U3")
def customer_segments(spark, sf):
    segmented, about = _segmented(spark, sf)
    traits = K.segment_traits(segmented, "segment", ["c_acctbal"], ["c_mktsegment"])
    return traits.withColumn("k", F.lit(about["k"])).withColumn("silhouette", F.lit(about["silhouette"]))


@query("U4")
def segment_scatter(spark, sf):
    return K.segment_scatter(_segmented(spark, sf)[0])


@query(
    "U3",
    """WITH d AS (SELECT l_returnflag AS seg, l_quantity, l_extendedprice, l_linestatus FROM lineitem),
    n AS (SELECT 'l_quantity' AS c, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM d UNION ALL SELECT 'l_extendedprice', avg(l_extendedprice), stddev_samp(l_extendedprice) FROM d),
    g AS (SELECT seg, 'l_quantity' AS c, avg(l_quantity) AS m FROM d GROUP BY seg UNION ALL SELECT seg, 'l_extendedprice', avg(l_extendedprice) FROM d GROUP BY seg),
    u AS (SELECT seg, l_linestatus AS v, count(*) AS n FROM d GROUP BY ALL),
    v AS (SELECT seg, v, n / sum(n) OVER (PARTITION BY seg) AS share, row_number() OVER (PARTITION BY seg ORDER BY n DESC, v) AS rn FROM u),
    b AS (SELECT l_linestatus AS v, count(*) / (SELECT count(*) FROM d) AS base FROM d GROUP BY 1),
    t AS (SELECT seg, c, abs((g.m - n.m) / n.s) AS strength FROM g JOIN n USING (c) UNION ALL SELECT seg, 'l_linestatus', abs(share - base) * 3 FROM v JOIN b USING (v) WHERE rn = 1)
    SELECT t.seg AS segment, size, c AS "column", round(strength, 6) AS strength,
    CAST(row_number() OVER (PARTITION BY t.seg ORDER BY strength DESC) AS INTEGER) AS position
    FROM t JOIN (SELECT seg, count(*) AS size FROM d GROUP BY seg) x ON x.seg = t.seg""",
)
def group_traits(spark, sf):
    traits = K.segment_traits(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"], ["l_linestatus"])
    return traits.select("segment", "size", "column", r("strength", 6), "position")


def _series_sql(source: str, key: str, ts: str, value: str, how: str, grain: str, fill: str, low: str = "", high: str = "") -> str:
    step = "INTERVAL 1 DAY" if grain == "day" else "INTERVAL 1 MONTH"
    return f"""WITH d AS (SELECT {key} AS k, {ts} AS ts, CAST({value} AS DOUBLE) AS v FROM {source}),
    q AS (SELECT k, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi, max(v) AS top, min(ts) AS a, max(ts) AS z FROM d GROUP BY k),
    p AS (SELECT k, CAST(date_trunc('{grain}', ts) AS DATE) AS period, {how}(CASE WHEN top > 3 * greatest(abs(hi), 1e-9) THEN least(greatest(v, lo), hi) ELSE v END) AS y,
      count(*) FILTER (top > 3 * greatest(abs(hi), 1e-9) AND (v > hi OR v < lo)) AS o FROM d JOIN q USING (k) GROUP BY ALL),
    c AS (SELECT k, a, z, CAST(unnest(generate_series(date_trunc('{grain}', a), date_trunc('{grain}', z), {step})) AS DATE) AS period FROM q),
    f AS (SELECT c.k, c.period, {fill} AS y, sum(coalesce(o, 0)) OVER (PARTITION BY c.k) AS outliers FROM c LEFT JOIN p ON p.k = c.k AND p.period = c.period
      WHERE '{grain}' = 'day' OR NOT ((c.period = CAST(date_trunc('{grain}', z) AS DATE) AND CAST(z AS DATE) < c.period + {step} - INTERVAL 1 DAY)
        OR (c.period = CAST(date_trunc('{grain}', a) AS DATE) AND CAST(a AS DATE) > c.period))),
    s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) - 1 AS t, count(*) OVER (PARTITION BY k) AS n FROM f)"""


_EVENT_SERIES = _series_sql("events", "event_type", "ts", "value", "sum", "day", "coalesce(y, 0)")
_ORDER_SERIES = _series_sql("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "avg", "month", "y")


@query(
    "F0 F0b F0c J5",
    f"""{_EVENT_SERIES} SELECT k AS event_type, 'day' AS grain, CASE WHEN n < 14 THEN 0 ELSE 7 END AS season, strftime(period, '%Y-%m-%d') AS period,
    round(y, 4) AS y, CAST(t AS INTEGER) AS t, n, CAST(outliers AS BIGINT) AS outliers FROM s""",
)
def daily_series(spark, sf):
    found = W.period_series(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return found.withColumn("period", F.date_format("period", "yyyy-MM-dd")).withColumn("y", F.round("y", 4))


@query(
    "F0 F0b F0c G11",
    f"""{_ORDER_SERIES} SELECT k AS o_orderstatus, 'month' AS grain, CASE WHEN n < 24 THEN 0 ELSE 12 END AS season, strftime(period, '%Y-%m-%d') AS period,
    round(y, 6) AS y, CAST(t AS INTEGER) AS t, n, CAST(outliers AS BIGINT) AS outliers FROM s""",
)
def monthly_series(spark, sf):
    found = W.period_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"])
    return found.withColumn("period", F.date_format("period", "yyyy-MM-dd")).withColumn("y", F.round("y", 6))


@query(
    "F1",
    f"""{_EVENT_SERIES}, k AS (SELECT *, greatest(1, least(3, n // 4)) AS r, least(greatest(3, n // 5), 12) AS h FROM s),
    w AS (SELECT k, isodow(period) AS d, avg(y) AS m FROM k GROUP BY ALL),
    x AS (SELECT k, arg_max(d, m) AS d, (max(m) - avg(m)) / abs(avg(m)) * 100 AS lift FROM w GROUP BY k)
    SELECT k.k AS event_type, 'day' AS grain, max(n) AS periods,
    round((sum(y) FILTER (t >= n - r) - sum(y) FILTER (t >= n - 2 * r AND t < n - r)) / abs(sum(y) FILTER (t >= n - 2 * r AND t < n - r)) * 100, 4) AS growth_pct,
    round(regr_slope(y, t), 6) AS trend_per_period,
    round(avg(abs(y - naive)) FILTER (t >= n - h), 4) AS naive_mae,
    ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][any_value(x.d)] AS peak, round(any_value(lift), 4) AS peak_lift_pct
    FROM (SELECT *, max(CASE WHEN t = n - h - 1 THEN y END) OVER (PARTITION BY k) AS naive FROM k) k JOIN x ON x.k = k.k GROUP BY k.k""",
)
def trend_summary(spark, sf):
    series = W.period_series(table(spark, sf, "events"), "ts", "value", ["event_type"])
    found = W.series_summary(series, ["event_type"])
    return found.select(
        "event_type", "grain", "periods", r("growth_pct"), r("trend_per_period", 6), r("naive_mae"), "peak", r("peak_lift_pct")
    )


def _fit_sql(name: str, rows: str) -> str:
    """Level, slope and effects of ridge regression from sums per season phase, for the rows of z that meet a condition."""
    return f"""{name}p AS (SELECT k, season, CASE WHEN season > 0 THEN t % season ELSE 0 END AS p, CAST(count(*) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS st, sum(y) AS sy,
      CAST(sum(t * t) AS DOUBLE) AS stt, sum(t * y) AS sty FROM z WHERE {rows} GROUP BY ALL),
    {name}w AS (SELECT *, CASE WHEN season > 0 THEN 1 / (c + 1.0) ELSE 0 END AS part FROM {name}p),
    {name}g AS (SELECT k, sum((1 - c * part) * c) AS aa, sum((1 - c * part) * st) AS ab, sum((1 - c * part) * sy) AS a1,
      sum(stt - st * st * part) + 1 AS bb, sum(sty - st * sy * part) AS b1 FROM {name}w GROUP BY k),
    {name}s AS (SELECT *, (aa * b1 - ab * a1) / (aa * bb - ab * ab) AS slope FROM {name}g),
    {name}f AS (SELECT k, slope, (a1 - slope * ab) / aa AS lvl FROM {name}s),
    {name}e AS (SELECT {name}w.k, p, lvl, slope, (sy - lvl * c - slope * st) * part AS effect FROM {name}w JOIN {name}f USING (k))"""


_MONTHS = f"{_ORDER_SERIES}, z AS (SELECT *, CASE WHEN n < 24 THEN 0 ELSE 12 END AS season FROM s), {_fit_sql('m', 'true')}"
_DAYS = f"""{_EVENT_SERIES}, z AS (SELECT *, CASE WHEN n < 14 THEN 0 ELSE 7 END AS season, least(greatest(3, n // 5), 12) AS h FROM s), {_fit_sql('d', 't < n - h')}"""


@query(
    "F1",
    f"""{_MONTHS}, v AS (SELECT z.k, stddev_pop(y - (lvl + slope * t + effect)) AS spread, max(period) AS last, max(n) AS n, max(z.season) AS season
      FROM z JOIN me ON me.k = z.k AND p = CASE WHEN season > 0 THEN t % season ELSE 0 END GROUP BY z.k),
    a AS (SELECT v.*, i, n + i - 1 AS pos, mf.lvl, mf.slope FROM v JOIN mf USING (k), (VALUES (1), (2), (3)) AS x(i))
    SELECT a.k AS o_orderstatus, strftime(last + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS period, round(a.lvl + a.slope * pos + coalesce(effect, 0), 2) AS forecast,
    round(a.lvl + a.slope * pos + coalesce(effect, 0) - 1.96 * spread, 2) AS lower, round(a.lvl + a.slope * pos + coalesce(effect, 0) + 1.96 * spread, 2) AS upper
    FROM a LEFT JOIN me ON me.k = a.k AND p = CASE WHEN season > 0 THEN pos % season ELSE 0 END""",
)
def ridge_forecasts(spark, sf):
    series = W.period_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"])
    points = W.forecast_points(W.ridge_forecast(series, ["o_orderstatus"]), ["o_orderstatus"])
    return points.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "F1",
    f"""{_DAYS}, r AS (SELECT z.*, max(CASE WHEN t = n - h - 1 THEN y END) OVER (PARTITION BY k) AS naive FROM z),
    m AS (SELECT r.k, abs(df.lvl + df.slope * t + coalesce(effect, 0) - y) AS miss, abs(naive - y) AS plain, y FROM r JOIN df ON df.k = r.k
      LEFT JOIN de ON de.k = r.k AND p = CASE WHEN season > 0 THEN t % season ELSE 0 END WHERE t >= n - h)
    SELECT k AS event_type, round(avg(miss), 2) AS mae, round(avg(plain), 2) AS naive_mae, round(avg(miss / greatest(abs(y), 1e-9)) * 100, 1) AS mape_pct, avg(miss) < avg(plain) AS beats_naive FROM m GROUP BY k""",
)
def forecast_backtests(spark, sf):
    series = W.period_series(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return W.ridge_forecast(series, ["event_type"]).select("event_type", "mae", "naive_mae", "mape_pct", "beats_naive")


@query("F5 G8")
def ranked_findings(spark, sf):
    """Findings on order sizes from capture, totals and the forecast."""
    orders = table(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int"))
    said, _ = N.capture_facts("o_orderstatus", "F", top_capture(orders, "o_totalprice", "hit").first(), "sales")
    mean = orders.agg(F.avg("o_totalprice").alias("m")).first()["m"]
    median = column_quantiles(orders, ["o_totalprice"], {"m": 0.5})["o_totalprice"]["m"]
    more, _ = N.regression_facts("o_totalprice", mean, median, top_share(orders, "o_totalprice", 0.2).first())
    series = materialize(W.period_series(orders, "o_orderdate", "o_totalprice"), "series")
    last = series.orderBy(F.desc("t")).first()["y"]
    trend, _, _ = N.forecast_facts("o_totalprice", W.series_summary(series).first(), W.ridge_forecast(series).first(), last)
    return N.rank_findings([*said, *more, *trend], spark)


@query(
    "F6",
    """WITH r AS (SELECT l_returnflag AS run_id, format('{:,}', count(*)) AS n, regr_r2(l_extendedprice, l_quantity) AS q, regr_r2(l_extendedprice, l_discount) AS d FROM lineitem GROUP BY 1),
    f AS (SELECT *, CASE WHEN q >= d THEN 'l_quantity' ELSE 'l_discount' END AS driver, format('{:.4f}', greatest(q, d)) AS score FROM r)
    SELECT run_id, 1 AS position, 'Executive Summary' AS section, n || ' rows, 11 columns. Linear Regression explains l_extendedprice best: R2 ' || score || '.' AS text FROM f
    UNION ALL SELECT run_id, 2, 'Top 3 Key Findings', '1. l_extendedprice depends most on ' || driver || '. 2. R2 is ' || score || '. 3. It rests on ' || n || ' rows.' FROM f
    UNION ALL SELECT run_id, 3, 'Top 3 Business Recommendations', '1. For orders above the threshold: more stock and sales time. 2. Follow ' || driver || '. 3. Fit again when new rows arrive.' FROM f
    UNION ALL SELECT run_id, 4, 'Risk Assessment', 'If ' || driver || ' shifts, the scores no longer hold.' FROM f
    UNION ALL SELECT run_id, 5, 'Predicted Impact', 'Not measured: compare orders with and without the step.' FROM f""",
)
def narratives(spark, sf):
    """One narrative per return flag, as if each were a run: the better of two simple regressions of the price."""
    lines = table(spark, sf, "lineitem")
    runs = lines.groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.regr_r2("l_extendedprice", "l_quantity").alias("q"), F.regr_r2("l_extendedprice", "l_discount").alias("d")
    )
    ready = runs.select(
        "run_id", F.lit("sales").alias("analysis_type"), "rows", F.lit(len(lines.columns)).alias("columns"), F.lit("l_extendedprice").alias("target"),
        F.lit("Linear Regression").alias("best_model"), F.lit("R2").alias("metric"), F.greatest("q", "d").alias("score"),
        F.when(F.col("q") >= F.col("d"), "l_quantity").otherwise("l_discount").alias("driver"),
    )
    return N.narrative(ready)


@query("F7 I1 I8 C8")
def report_tables(spark, sf):
    raw = customers_with_holes(spark, sf)
    return N.report_tables(inspect(raw), clean(raw)[1], None, spark)


@query("F5 I14 U6 F1")
def analysis_findings(spark, sf):
    """The full flow on events with a numeric outcome."""
    events = table(spark, sf, "events").drop("props")
    return analyze(spark, events, target="value").findings


@query("I12 U2 E6 F5", "SELECT 'correlation' AS kind FROM orders HAVING corr(o_totalprice, o_totalprice * 0.9 + o_custkey % 7) > 0.5 UNION ALL SELECT 'segments' UNION ALL SELECT 'anomalies'")
def findings_without_outcome(spark, sf):
    """The full flow on orders, where no column stands out as an outcome: segments, linked columns, unusual rows."""
    net = (F.col("o_totalprice") * 0.9 + F.col("o_custkey") % 7).alias("o_net")
    run = analyze(spark, table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", net), gate=False)
    if run.info["target"] is not None or run.model is not None:
        raise AssertionError("An outcome was made up.")
    return run.findings.select("kind").distinct()
