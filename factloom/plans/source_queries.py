"""Queries that write given tables in a file format and read them back, and the run store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.clean import clean
from factloom.operators.facts import evidence_lines
from factloom.plans.registry import TABLES, query, table
from factloom.session import materialize, scratch_path
from factloom.sources import readers as R
from factloom.sources import runstore as S
from factloom.sources import tables as T
from factloom.sources import workbook as W
from factloom.sources.sinks import enriched, write_table


@query("S1 S2 K1", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv") + ".csv"
    write_table(table(spark, sf, "customer"), path, "csv")
    return R.read_any(spark, path)


@query("S1 S2 K1", """SELECT doc_id, md5('"' || text || '"; said, twice:' || chr(10) || ' "' || source || '" ') AS text FROM documents""")
def quoted_csv_round_trip(spark, sf):
    """Whole texts with quotes, separators and line breaks, written and read as CSV."""
    path = scratch_path(spark, "quoted") + ".csv"
    said = F.concat(F.lit('"'), "text", F.lit('"; said, twice:\n "'), "source", F.lit('" '))
    write_table(table(spark, sf, "documents").select("doc_id", said.alias("text")), path, "csv")
    return R.read_delimited(spark, path, ",").select("doc_id", F.md5("text").alias("text"))


@query("S4", "SELECT doc_id, md5(text) AS text FROM documents WHERE lang IN ('de', 'fr', 'es')")
def latin_csv_round_trip(spark, sf):
    """Texts with accents in another character set, which is an option of the reader."""
    path = scratch_path(spark, "latin") + ".csv"
    accents = table(spark, sf, "documents").where("lang IN ('de', 'fr', 'es')").select("doc_id", "text")
    accents.write.options(header=True, encoding="ISO-8859-1", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return R.read_delimited(spark, path, ",", "ISO-8859-1").select("doc_id", F.md5("text").alias("text"))


@query("C5 S19", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders")
def slash_dates(spark, sf):
    """Day before month: one layout for the whole column, also where the day is twelve or less."""
    text = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"))
    return clean(text)[0].withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("S7 S5", 'SELECT c_custkey AS "id", c_name AS "who.name", c_mktsegment AS "who.segment", c_acctbal AS "balance" FROM customer')
def nested_json_records(spark, sf):
    """A folder of documents, each with a list of two-level records inside an object."""
    path = scratch_path(spark, "documents") + ".json"
    record = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"), F.col("c_acctbal").alias("balance"))
    documents = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.collect_list(record).alias("records"))
    whole = documents.select(F.struct(F.col("part").alias("version")).alias("metadata"), F.struct("records").alias("payload"))
    whole.write.option("maxRecordsPerFile", 1).json(path)
    return R.read_any(spark, path)


@query("S8", "SELECT event_id, user_id, value FROM events WHERE event_id % 10 <> 3")
def malformed_json_lines(spark, sf):
    """Every tenth line is cut off: the reader refuses the file, and drops the bad lines only when asked to."""
    path = scratch_path(spark, "malformed") + ".jsonl"
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    cut = F.when(F.col("event_id") % 10 == 3, F.left(line, F.lit(12))).otherwise(line)
    table(spark, sf, "events").select(cut.alias("value")).write.text(path)
    try:
        R.read_json_lines(spark, path)
    except R.SourceError:
        return R.read_json_lines(spark, path, bad="drop")
    raise AssertionError("A malformed line was not noticed.")


@query("S2", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def semicolon_round_trip(spark, sf):
    """The delimiter is found from the text."""
    path = scratch_path(spark, "semicolon") + ".txt"
    table(spark, sf, "supplier").write.option("header", True).option("sep", ";").csv(path)
    return R.read_any(spark, path)


@query("S2", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def tab_round_trip(spark, sf):
    path = scratch_path(spark, "tab") + ".tsv"
    table(spark, sf, "part").write.option("header", True).option("sep", "\t").csv(path)
    return R.read_any(spark, path)


@query(
    "S3",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 2 THEN c_name || ', the "second"' WHEN c_custkey % 10 = 3 THEN c_name || chr(10) || 'third' ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0""",
)
def bad_csv_lines(spark, sf):
    """Every tenth line has a field too many and goes; the next one lacks its last field, two have quoted separators, quotes and line breaks."""
    key = F.col("c_custkey")
    line = (
        F.when(key % 10 == 0, F.concat_ws(",", "c_custkey", "c_name", "c_acctbal", F.lit("surplus")))
        .when(key % 10 == 1, F.concat_ws(",", "c_custkey", "c_name"))
        .when(key % 10 == 2, F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit(', the ""second"""')), "c_acctbal"))
        .when(key % 10 == 3, F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('\nthird"')), "c_acctbal"))
        .otherwise(F.concat_ws(",", "c_custkey", "c_name", "c_acctbal"))
    )
    lines = table(spark, sf, "customer").select(
        F.pmod(F.xxhash64("c_custkey"), F.lit(4)).alias("file"), F.lit(1).alias("at"), line.alias("value")
    )
    # A header line starts every file, as in a folder of exports.
    heads = spark.range(4).select(F.col("id").alias("file"), F.lit(0).alias("at"), F.lit("c_custkey,c_name,c_acctbal").alias("value"))
    path = scratch_path(spark, "bad") + ".csv"
    both = lines.unionByName(heads).repartition(4, "file").sortWithinPartitions("file", "at")
    both.drop("at").write.partitionBy("file").text(path)
    return reduce(DataFrame.unionByName, [R.read_delimited(spark, f"{path}/file={i}", ",") for i in range(4)])


@query("S8 S5 S17", "SELECT event_id, user_id, event_type, value FROM events")
def json_lines_round_trip(spark, sf):
    path = scratch_path(spark, "lines") + ".jsonl"
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return R.read_any(spark, path)


@query(
    "S5",
    'SELECT o_orderkey AS "id", o_totalprice AS "metrics.price", o_orderstatus AS "state.status", o_orderpriority AS "state.priority" FROM orders',
)
def nested_json_columns(spark, sf):
    """Objects inside records become dotted columns."""
    path = scratch_path(spark, "nested") + ".jsonl"
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_totalprice").alias("price")).alias("metrics"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state"),
    ).write.json(path)
    return R.read_any(spark, path)


@query("S5 S16", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_payload_rows(spark, sf):
    rows = R.records_from_payload(table(spark, sf, "events"), "props")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("S6", "SELECT c_acctbal, c_custkey, c_mktsegment FROM customer")
def json_column_lists(spark, sf):
    """Objects of lists, a hundred customers in each."""
    path = scratch_path(spark, "lists") + ".json"
    batches = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("batch")).agg(
        F.collect_list(F.struct("c_custkey", "c_acctbal", "c_mktsegment")).alias("r")
    )
    batches.select("r.c_custkey", "r.c_acctbal", "r.c_mktsegment").write.json(path)
    return R.unpack_records(spark.read.json(path))


@query("S9", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "columns") + ".parquet"
    write_table(table(spark, sf, "orders"), path)
    return R.read_any(spark, path).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("S10", "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def xml_round_trip(spark, sf):
    path = scratch_path(spark, "rows") + ".xml"
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    parts.write.option("rowTag", "row").option("rootTag", "rows").xml(path)
    return R.read_any(spark, path)


@query("S12", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sheet_cells_to_table(spark, sf):
    """Customers as the cells of one workbook per segment, with a title row above the header."""
    customer = table(spark, sf, "customer")
    names = customer.columns
    place = F.col("c_mktsegment").alias("path")
    cells = customer.select(
        place, (F.col("c_custkey") + 3).cast("int").alias("row"),
        F.posexplode(F.array(*[F.col(c).cast("string") for c in names])).alias("col", "value"),
    )
    heads = customer.select(place).distinct().select(
        "path", F.lit(2).alias("row"), F.posexplode(F.array(*[F.lit(c) for c in names])).alias("col", "value")
    )
    titles = customer.select(place).distinct().select("path", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("Customer export").alias("value"))
    book = cells.unionByName(heads).unionByName(titles).withColumn("sheet", F.lit("data"))
    notes = titles.withColumn("sheet", F.lit("notes"))
    picked = W.largest_sheet(materialize(book.unionByName(notes), "cells"))
    return R.infer_types(materialize(W.cells_to_table(W.promote_header(picked)).drop("path", "row"), "sheet-rows"))


@query("S11 S12", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, '<' || c_mktsegment || ' & more>' AS segment FROM customer")
def workbook_round_trip(spark, sf):
    """Customers written as workbooks of a few hundred rows and read back, each sheet by a task of its own."""
    path = scratch_path(spark, "books")
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", F.concat(F.lit("<"), "c_mktsegment", F.lit(" & more>")).alias("segment")
    )
    W.write_workbooks(rows.repartition(2 * spark.sparkContext.defaultParallelism), path, 400)
    return W.read_workbooks(spark, path)


@query("S13", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_sizes(spark, sf):
    return T.table_sizes({t: table(spark, sf, t) for t in TABLES})


@query("S13", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def largest_table(spark, sf):
    tables = {t: table(spark, sf, t) for t in TABLES}
    return tables[T.largest_of(tables)].groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("S14", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def union_same_header(spark, sf):
    """Tables with the header of the first are stacked; the supplier table is left out."""
    customer = table(spark, sf, "customer")
    parts = [customer.filter(F.col("c_mktsegment") == m).select("c_custkey", "c_acctbal") for m in ("BUILDING", "FURNITURE")]
    return R.union_same_schema_or_largest([parts[0], table(spark, sf, "supplier"), parts[1]])


@query("S15", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, '.parquet' AS extension, 'ok' AS verdict" for t in TABLES))
def source_validation(spark, sf):
    found = R.validate_source(spark, sf, (".parquet", ".csv"), 20 * 2**20)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "extension", "verdict")


@query("S17 S18", 'SELECT c_custkey AS "key", c_name AS "Name", c_acctbal AS "name_1", c_mktsegment AS "column_4" FROM customer')
def tidy_table(spark, sf):
    """Blank, spaced and repeated names are repaired; the empty column and empty rows go."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(None).cast("string").alias("e"), "c_mktsegment")
    blank = customer.select(*[F.lit(None).cast(t).alias(n) for n, t in customer.dtypes])
    return R.tidy(customer.unionByName(blank).toDF("  key ", "Name", "name", "empty  col", " "))


@query("K2 K7 G8", "SELECT o_orderkey, o_totalprice / 500000 AS prediction_score FROM orders")
def enriched_sink(spark, sf):
    """Scored rows are written in descending order of the score and read back."""
    scored = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 500_000).alias("prediction_score"))
    path = scratch_path(spark, "enriched")
    write_table(enriched(scored), path)
    return spark.read.parquet(path)


def stored(spark: SparkSession, sf: str) -> S.RunStore:
    """Nations as runs, their customers as predictions and their suppliers as insights."""
    store = S.RunStore(spark, scratch_path(spark, "store"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    run = F.col("c_nationkey").cast("string").alias("run_id")
    store.append(
        "predictions",
        table(spark, sf, "customer").select(
            F.col("c_custkey").alias("item_id"), F.to_json(F.struct("c_name")).alias("inputs"),
            F.to_json(F.struct("c_acctbal")).alias("output"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"), run,
        ),
    )
    store.append(
        "insights",
        table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("text"), F.lit("rules").alias("source"),
            F.col("s_nationkey").cast("string").alias("run_id"),
        ),
    )
    nation = table(spark, sf, "nation")
    store.append(
        "runs",
        nation.select(
            F.when(F.col("n_regionkey") != 0, F.concat(F.lit("owner"), F.col("n_regionkey").cast("string"))).alias("user_id"),
            F.col("n_name").alias("filename"), now.alias("created_at"), F.lit(None).cast("string").alias("target"),
            F.lit("classification").alias("problem_type"), F.lit("{}").alias("model_card"),
            F.col("n_nationkey").cast("string").alias("run_id"),
        ),
    )
    gone = nation.filter(F.col("n_regionkey") == 4).select(now.alias("deleted_at"), F.col("n_nationkey").cast("string").alias("run_id"))
    store.append("tombstones", gone)
    return store


@query(
    "K5 K6 J2 J3 J4",
    """SELECT CAST(n_nationkey AS VARCHAR) AS run_id, n_name AS filename, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS predictions_count,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS insights_count FROM nation WHERE n_regionkey IN (0, 1)""",
)
def run_overview(spark, sf):
    """Runs that one owner may open: their own and those without an owner, none deleted."""
    store = stored(spark, sf)
    runs = S.visible_runs(store.table("runs"), store.table("tombstones"), "owner1")
    children = {n: store.table(n) for n in ("predictions", "insights")}
    return S.run_overview(runs.select("run_id", "filename"), children)


@query(
    "K5 K6 J2 J4",
    """SELECT CAST(n_nationkey AS VARCHAR) AS run_id, n_name AS filename, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS predictions_count,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS insights_count FROM nation""",
)
def retried_save(spark, sf):
    """A first attempt dies before it is finished, a second saves all runs, a third repeats it: every row counts once."""
    source, target = stored(spark, sf), S.RunStore(spark, scratch_path(spark, "retried"))
    parts = {n: source.table(n) for n in ("predictions", "insights", "runs")}
    target.stage("run", "died", **parts)
    for _ in range(2):
        target.commit("run", **parts)
    children = {n: target.table(n) for n in ("predictions", "insights")}
    return S.run_overview(target.table("runs").select("run_id", "filename"), children)


@query("J3 J4 G8", "SELECT CAST(n_nationkey AS VARCHAR) AS run_id, n_name AS filename FROM nation WHERE n_regionkey = 2")
def run_list(spark, sf):
    return stored(spark, sf).list("owner2").select("run_id", "filename")


@query(
    "J2 J4",
    """SELECT CAST(n_nationkey AS VARCHAR) AS run_id, 'run' AS section, CAST(0 AS BIGINT) AS item_id FROM nation WHERE n_regionkey <> 4
    UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'predictions', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4
    UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'insights', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 4""",
)
def run_documents(spark, sf):
    store = stored(spark, sf)
    runs = S.visible_runs(store.table("runs"), store.table("tombstones"))
    parts = {n: store.table(n) for n in ("predictions", "insights")}
    return S.run_document(runs, parts).select("run_id", "section", "item_id")


@query(
    "J4",
    """SELECT CAST(c_nationkey AS VARCHAR) AS run_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4 GROUP BY 1""",
)
def compacted_store(spark, sf):
    copy = stored(spark, sf).compact(scratch_path(spark, "compact"))
    return copy.table("predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T8 G8",
    """SELECT CAST(s_nationkey AS VARCHAR) AS run_id, CAST(2 AS INTEGER) AS priority, 'Stored insight ' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS source, s_name AS content FROM supplier
    UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 5, 'Saved prediction ' || rn, 'inputs: {"c_name":"' || c_name || '"}; result: {"c_acctbal":' || c_acctbal || '}' FROM
      (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn <= 5""",
)
def stored_evidence(spark, sf):
    store = stored(spark, sf)
    lines = evidence_lines({n: store.table(n) for n in ("insights", "predictions")})
    return lines.select("run_id", "priority", "source", "content")
