"""Queries over the inspection, profiling, cleaning and relevance operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.modeling.predict import contract_categories, schema_contract
from factloom.operators import profile as P
from factloom.operators import semantic as S
from factloom.operators.clean import clean, clean_report, coerce_money
from factloom.operators.relevance import BUSINESS_WORDS, OUTCOME_WORDS, TIME_WORDS, relevance_catalog
from factloom.plans.registry import TABLES, query, rounded, table

COLUMNS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}

# Customers with deterministic holes, the same in both engines.
HOLES = """holes AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


def customers_with_holes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").withColumns(
        {
            "c_acctbal": F.when(key % 7 != 0, F.col("c_acctbal")),
            "c_mktsegment": F.when(key % 3 != 0, F.col("c_mktsegment")),
        }
    )


@query(
    "I1",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({COLUMNS[t]} AS BIGINT) AS column_count FROM {t}"
        for t in TABLES
    ),
)
def table_shapes(spark, sf):
    return reduce(DataFrame.unionByName, [P.table_shape(table(spark, sf, t), t) for t in TABLES])


_LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


@query(
    "I9",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round_even(avg({c}), 4) AS mean, round_even(median({c}), 4) AS median,
        round_even(stddev_samp({c}), 4) AS std, round_even(CAST(min({c}) AS DOUBLE), 4) AS min, round_even(CAST(max({c}) AS DOUBLE), 4) AS max,
        round_even(skewness({c}), 4) AS skewness, count(*) - count({c}) AS nulls FROM lineitem"""
        for c in _LINEITEM_NUMBERS
    ),
)
def inspect_numeric_stats(spark, sf):
    return P.numeric_stats(table(spark, sf, "lineitem"), digits=4)


@query(
    "I2 I3",
    f"""WITH {HOLES}, n AS (SELECT count(*) AS n FROM holes)
    SELECT "column", kind, dtype, nulls, round(nulls / n, 6) AS share FROM n, (
      SELECT 'c_custkey' AS "column", 'numerical' AS kind, 'bigint' AS dtype, count(*) - count(c_custkey) AS nulls FROM holes
      UNION ALL SELECT 'c_name', 'categorical', 'string', count(*) - count(c_name) FROM holes
      UNION ALL SELECT 'c_nationkey', 'numerical', 'int', count(*) - count(c_nationkey) FROM holes
      UNION ALL SELECT 'c_acctbal', 'numerical', 'double', count(*) - count(c_acctbal) FROM holes
      UNION ALL SELECT 'c_mktsegment', 'categorical', 'string', count(*) - count(c_mktsegment) FROM holes)""",
)
def missing_by_column(spark, sf):
    return rounded(P.missing_values(customers_with_holes(spark, sf)), 6)


@query(
    "I19",
    f"""WITH {HOLES} SELECT 'c_mktsegment' AS "column", count(*) - count(c_mktsegment) AS nulls,
    round((count(*) - count(c_mktsegment)) / count(*), 6) AS share FROM holes
    HAVING (count(*) - count(c_mktsegment)) / count(*) > 0.2""",
)
def high_missing_columns(spark, sf):
    return rounded(P.high_missing(customers_with_holes(spark, sf)), 6)


@query(
    "I4 G7",
    """WITH d AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)
    SELECT (SELECT count(*) FROM d) AS row_count, count(*) AS distinct_rows,
           (SELECT count(*) FROM d) - count(*) AS duplicates FROM (SELECT DISTINCT * FROM d)""",
)
def duplicate_rows(spark, sf):
    events = table(spark, sf, "events")
    return P.duplicate_rows(events.unionByName(events.filter(F.col("event_id") % 50 == 0)))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_ORDER_COUNTS = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count(*) AS n FROM orders"""
    for i, c in enumerate(_ORDER_COLUMNS)
)


@query(
    "I5",
    f"""SELECT "column", distinct_values, round(distinct_values / n, 6) AS ratio,
    regexp_matches("column", '(id|uuid|guid|key|index)$') AS id_name,
    regexp_matches("column", '(id|uuid|guid|key|index)$') AND distinct_values / n > 0.6 AS is_id FROM ({_ORDER_COUNTS})""",
)
def id_columns(spark, sf):
    return rounded(P.id_columns(table(spark, sf, "orders")), 6)


@query(
    "I6 I8",
    f"""SELECT "column" AS target, distinct_values AS unique_count, 'classification' AS problem_type FROM ({_ORDER_COUNTS})
    WHERE distinct_values BETWEEN 2 AND 10 ORDER BY position DESC LIMIT 1""",
)
def detected_target(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.count()
    target = P.detect_target(orders, exclude=P.id_column_names(orders, rows))
    unique = P.few_valued(orders, [target])[target]
    problem = P.problem_type(target in ("o_orderkey", "o_custkey", "o_totalprice"), unique)
    return spark.createDataFrame([(target, unique, problem)], "target string, unique_count bigint, problem_type string")


@query(
    "I7 I8 G1",
    """SELECT 'o_orderpriority' AS target, o_orderpriority AS value, count(*) AS n,
    (SELECT count(DISTINCT o_orderpriority) FROM orders) AS unique_count, false AS is_numeric,
    'classification' AS problem_type FROM orders GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 5""",
)
def target_top_values(spark, sf):
    return P.target_info(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "G1 G8",
    """WITH c AS (
      SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
      UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
      UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size)
    SELECT "column", value, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share,
    CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS position
    FROM c QUALIFY position <= 6""",
)
def top_values(spark, sf):
    return rounded(P.top_values(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], 6), 6)


def _range_fact(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", printf('mean %.2f; median %.2f; min %.2f; max %.2f',
    round_even(avg({column}), 2), round_even(median({column}), 2), CAST(min({column}) AS DOUBLE), CAST(max({column}) AS DOUBLE)) AS fact FROM {source}"""


def _share_fact(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", string_agg(printf('%s: %.1f%%', v, n * 100.0 / t), '; ' ORDER BY n DESC, v)
    || ' (of ' || format('{{:,}}', CAST(max(t) AS BIGINT)) || ' rows)' AS fact FROM (
      SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER () AS t,
      row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS rn
      FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rn <= 6"""


@query(
    "I15",
    " UNION ALL ".join(
        [_range_fact(c, "lineitem") for c in ("l_quantity", "l_extendedprice")]
        + [_share_fact(c, "lineitem") for c in ("l_linenumber", "l_returnflag", "l_linestatus")]
    ),
)
def column_facts(spark, sf):
    kept = ["l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag", "l_linestatus"]
    return P.column_facts(table(spark, sf, "lineitem").select(*kept))


_CARD_SQL = f"""WITH {HOLES}, s AS (SELECT count(*) AS n,
  2 * count(*) - count(c_acctbal) - count(c_mktsegment) AS missing, avg(c_acctbal) AS m FROM holes),
 b AS (SELECT c_mktsegment AS v, count(*) AS k FROM holes WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1)
 SELECT 'Customers' AS title, 'Rows: ' || format('{{:,}}', n) || '; Cols: 5; Missing: ' || missing || '; ' || @LAST@ AS numbers,
 'Customers reflects a data profile with ' || format('{{:,}}', n) || ' rows and ' || missing
 || ' missing values across the dataset.' AS finding FROM s, b"""


@query("I16", _CARD_SQL.replace("@LAST@", "printf('Mode c_mktsegment: %s (%.1f%%)', v, k * 100.0 / n)"))
def fact_card_mode(spark, sf):
    return P.fact_card(customers_with_holes(spark, sf), "Customers", "c_mktsegment")


@query("I16", _CARD_SQL.replace("@LAST@", "printf('Avg c_acctbal: %.2f', m)"))
def fact_card_mean(spark, sf):
    return P.fact_card(customers_with_holes(spark, sf), "Customers", "c_acctbal")


@query(
    "I17",
    f"""WITH {HOLES}, d AS (SELECT * FROM holes UNION ALL SELECT * FROM holes WHERE c_custkey % 50 = 0),
    a AS (SELECT count(*) AS row_count, 2 * count(*) - count(c_acctbal) - count(c_mktsegment) AS nulls,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates FROM d),
    i AS (SELECT *, greatest(0.0, 100 - (nulls + duplicates) / row_count * 100) AS integrity FROM a)
    SELECT row_count, nulls, duplicates, round(integrity, 4) AS integrity,
    CASE WHEN integrity >= 95 THEN 'High Integrity' WHEN integrity >= 80 THEN 'Good Integrity' ELSE 'Needs Review' END AS label FROM i""",
)
def integrity_index(spark, sf):
    holes = customers_with_holes(spark, sf)
    return rounded(P.integrity_index(holes.unionByName(holes.filter(F.col("c_custkey") % 50 == 0))))


_DESCRIBED = {"orders": ("o_orderkey", "o_custkey", "o_totalprice")}


@query(
    "I20 G4",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75,
        round(CAST(max({c}) AS DOUBLE), 4) AS max FROM orders"""
        for c in _DESCRIBED["orders"]
    ),
)
def describe_numeric(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "orders")))


_TEXT_ORDERS = """t AS (SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_orderpriority FROM orders)"""


@query(
    "I10 I11",
    f"""WITH {_TEXT_ORDERS}, n AS (SELECT count(*) AS n FROM t), f AS (
      SELECT 0 AS position, 'order_id' AS "column", 'whole' AS type, count(DISTINCT order_id) AS d, avg(length(CAST(order_id AS VARCHAR))) AS l, 0.0 AS dates FROM t
      UNION ALL SELECT 1, 'o_custkey', 'whole', count(DISTINCT o_custkey), avg(length(CAST(o_custkey AS VARCHAR))), 0 FROM t
      UNION ALL SELECT 2, 'o_orderstatus', 'text', count(DISTINCT o_orderstatus), avg(length(o_orderstatus)), avg(CASE WHEN try_cast(o_orderstatus AS DATE) IS NULL THEN 0.0 ELSE 1.0 END) FROM t
      UNION ALL SELECT 3, 'o_totalprice', 'float', count(DISTINCT o_totalprice), NULL, 0 FROM t
      UNION ALL SELECT 4, 'ordered', 'text', count(DISTINCT ordered), avg(length(ordered)), avg(CASE WHEN try_cast(ordered AS DATE) IS NULL THEN 0.0 ELSE 1.0 END) FROM t
      UNION ALL SELECT 5, 'o_orderpriority', 'text', count(DISTINCT o_orderpriority), avg(length(o_orderpriority)), avg(CASE WHEN try_cast(o_orderpriority AS DATE) IS NULL THEN 0.0 ELSE 1.0 END) FROM t)
    SELECT CAST(position AS INTEGER) AS position, "column", d AS distinct_values, round(d / n, 6) AS ratio,
    CASE WHEN type <> 'float' AND d = 2 THEN 'boolean'
      WHEN type <> 'text' AND regexp_matches("column", '(id|uuid|guid|index)$') AND d / n > 0.9 THEN 'id'
      WHEN type = 'whole' AND d <= 10 THEN 'categorical' WHEN type <> 'text' THEN 'numeric'
      WHEN dates >= 0.9 AND l >= 6 THEN 'datetime'
      WHEN (regexp_matches("column", '(id|uuid|guid|key)$') AND d / n > 0.5) OR (d / n > 0.95 AND l < 40) THEN 'id'
      WHEN l > 40 AND d / n > 0.5 THEN 'text' WHEN d <= 50 OR d / n < 0.05 THEN 'categorical'
      ELSE 'high_cardinality' END AS kind FROM f, n""",
)
def semantic_profile(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), "o_orderpriority",
    )
    return rounded(S.semantic_profile(orders).drop("avg_length"), 6)


@query("I10 I12 I13 I14")
def scored_targets(spark, sf):
    """The profiler's choice of target, metric and plan for several tables."""
    rows = []
    for name, kind in (("orders", "sales"), ("customer", "churn"), ("lineitem", "general"), ("labels", "fraud")):
        _, info = S.profile(table(spark, sf, name), kind)
        rows.append(
            (name, kind, info["target"], info["confidence"], info["reason"], info["problem"],
             info["positive_label"], info["time_column"], info["metric"], ",".join(info["plan"]))
        )
    return spark.createDataFrame(
        rows,
        "table_name string, analysis_type string, target string, confidence double, reason string, problem string, "
        "positive_label string, time_column string, metric string, steps string",
    )


_LABELLED = (("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("customer", "c_mktsegment"), ("labels", "toxic"))
_POSITIVE = ", ".join(f"'{w}'" for w in S.POSITIVE_WORDS)


@query(
    "I13",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS "column", coalesce(min(CASE WHEN lower(trim(v)) IN ({_POSITIVE}) THEN v END),
        arg_min(v, n * 1000 + r)) AS label FROM (SELECT v, n, row_number() OVER (ORDER BY v) AS r FROM
        (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1))"""
        for t, c in _LABELLED
    ),
)
def positive_labels(spark, sf):
    rows = [(t, c, S.positive_label(table(spark, sf, t), c)) for t, c in _LABELLED]
    return spark.createDataFrame(rows, "table_name string, column string, label string")


@query(
    "I18",
    """SELECT 'c_custkey' AS field, CAST(0 AS INTEGER) AS position, 'numeric' AS kind, 'bigint' AS dtype, CAST(min(c_custkey) AS DOUBLE) AS min, CAST(max(c_custkey) AS DOUBLE) AS max FROM customer
    UNION ALL SELECT 'c_name', 1, 'categorical', 'string', NULL, NULL
    UNION ALL SELECT 'c_nationkey', 2, 'numeric', 'int', CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE) FROM customer
    UNION ALL SELECT 'c_acctbal', 3, 'numeric', 'double', min(c_acctbal), max(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 4, 'categorical', 'string', NULL, NULL""",
)
def schema_contract_fields(spark, sf):
    return schema_contract(table(spark, sf, "customer"))


@query(
    "I18",
    """SELECT DISTINCT 'p_brand' AS field, p_brand AS category FROM part
    UNION ALL SELECT DISTINCT 'p_type', p_type FROM part UNION ALL SELECT DISTINCT 'p_name', p_name FROM part""",
)
def schema_contract_categories(spark, sf):
    return contract_categories(table(spark, sf, "part"))


# Parts with holes, padding and repeated rows.
RAW_PARTS = """raw AS (SELECT p_partkey,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS p_brand, ' ' || p_type || '  ' AS p_type,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part),
  kept AS (SELECT DISTINCT * FROM (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE p_partkey % 50 = 0))"""


def raw_parts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        "p_partkey",
        F.when(key % 13 != 0, F.col("p_brand")).alias("p_brand"),
        F.concat(F.lit(" "), "p_type", F.lit("  ")).alias("p_type"),
        F.when(key % 7 != 0, F.col("p_size")).alias("p_size"),
        F.when(key % 11 != 0, F.col("p_retailprice")).alias("p_retailprice"),
    )
    return raw.unionByName(raw.filter(key % 50 == 0))


@query(
    "C1 C4 C6 C7 C8",
    f"""WITH {RAW_PARTS}, f AS (SELECT median(p_size) AS s, median(p_retailprice) AS p FROM kept),
    b AS (SELECT p_brand AS v FROM kept WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT p_partkey, coalesce(p_brand, v) AS p_brand, trim(p_type) AS p_type,
    coalesce(CAST(p_size AS DOUBLE), s) AS p_size, round(coalesce(p_retailprice, p), 4) AS p_retailprice FROM kept, f, b""",
)
def clean_impute(spark, sf):
    return rounded(clean(raw_parts(spark, sf))[0], 4, ("p_retailprice",))


@query(
    "C8 K1",
    f"""WITH {RAW_PARTS}, f AS (SELECT median(p_size) AS s, median(p_retailprice) AS p, count(*) AS n,
      count(*) - count(p_brand) AS nb, count(*) - count(p_size) AS ns, count(*) - count(p_retailprice) AS np FROM kept),
    a AS (SELECT count(*) + (SELECT count(*) FROM raw WHERE p_partkey % 50 = 0) AS n FROM raw),
    b AS (SELECT p_brand AS v FROM kept WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT 'original_shape' AS section, CAST(0 AS INTEGER) AS position, a.n || ' x 5' AS detail FROM a
    UNION ALL SELECT 'cleaned_shape', 0, f.n || ' x 5' FROM f
    UNION ALL SELECT 'nulls_remaining', 0, '0'
    UNION ALL SELECT 'step', 1, 'Removed ' || (a.n - f.n) || ' duplicate rows' FROM a, f
    UNION ALL SELECT 'step', 2, 'Filled ' || nb || ' nulls in ''p_brand'' with mode (''' || v || ''')' FROM f, b
    UNION ALL SELECT 'step', 3, 'Filled ' || ns || printf(' nulls in ''p_size'' with median (%.2f)', s) FROM f
    UNION ALL SELECT 'step', 4, 'Filled ' || np || printf(' nulls in ''p_retailprice'' with median (%.2f)', p) FROM f""",
)
def clean_steps(spark, sf):
    raw = raw_parts(spark, sf)
    return clean_report(raw, clean(raw)[1])


@query(
    "C2 C3 C4 C5 S19",
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS amount,
      date_trunc('second', ts) AS event_time, event_type FROM events), m AS (SELECT median(amount) AS m FROM raw)
    SELECT event_id, round(coalesce(amount, m), 4) AS amount, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, event_type FROM raw, m""",
)
def clean_coercion(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("event_type"),
    )
    cleaned, _ = clean(raw)
    return cleaned.select("event_id", F.round("amount", 4).alias("amount"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_type")


@query(
    "C9",
    """WITH m AS (SELECT median(c_acctbal) AS m FROM customer WHERE c_custkey % 9 <> 0)
    SELECT c_custkey, round(CASE WHEN c_custkey % 9 = 0 THEN m ELSE c_acctbal END, 4) AS c_acctbal FROM customer, m""",
)
def money_coercion(spark, sf):
    raw = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")
    )
    return rounded(coerce_money(raw, "c_acctbal"))


_MONEY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": list(_LINEITEM_NUMBERS), "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
_TIMED = {"orders", "lineitem", "events"}


def _relevance_sql(name: str) -> str:
    words, times, goals = "|".join(BUSINESS_WORDS), "|".join(TIME_WORDS), "|".join(OUTCOME_WORDS)
    money = " OR ".join(f"(min({c}) >= 0 AND avg({c}) BETWEEN 5 AND 500000 AND max({c}) > 10)" for c in _MONEY[name])
    timed = "true" if name in _TIMED else f"EXISTS (SELECT 1 FROM (DESCRIBE {name}) WHERE regexp_matches(lower(column_name), '{times}'))"
    return f"""SELECT '{name}' AS table_name, CAST(least(100, pts) AS BIGINT) AS score,
    CASE WHEN least(100, pts) >= 50 THEN 'business' WHEN least(100, pts) >= 25 THEN 'borderline' ELSE 'not_business' END AS verdict,
    money_signal, columns_found FROM (SELECT money_signal, columns_found,
      least(45, 15 * hits) + CASE WHEN money_signal THEN 20 ELSE 0 END + CASE WHEN {timed} THEN 20 ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM (DESCRIBE {name}) WHERE regexp_matches(lower(column_name), '{goals}')) THEN 15 ELSE 0 END AS pts
      FROM (SELECT coalesce({money}, false) AS money_signal FROM {name}),
      (SELECT coalesce(string_agg(column_name, ', ' ORDER BY rn), '') AS columns_found, count(*) AS hits FROM
        (SELECT column_name, row_number() OVER () AS rn FROM (DESCRIBE {name})) WHERE regexp_matches(lower(column_name), '{words}')))"""


@query("R1 R2 R3 R4 R5", " UNION ALL ".join(_relevance_sql(t) for t in TABLES))
def relevance_gate(spark, sf):
    return relevance_catalog({t: table(spark, sf, t) for t in TABLES})
