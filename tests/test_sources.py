"""Files of every supported kind, built by hand, and the run store."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.sources import readers, sinks
from factloom.sources import workbook as W
from factloom.sources.runstore import RunStore
from factloom.sources.workbook import first_full_row_header

ROWS = [(i, ["Sales", "IT", "HR"][i % 3], i % 20, 30000.0 + i * 250.5, ["Low", "High"][i % 2]) for i in range(100)]
NAMES = ["id", "department", "experience", "salary", "performance"]


def tickets(n: int = 150) -> dict:
    priorities = ["High"] * 42 + ["Medium"] * 40 + ["Low"] * 40 + ["Critical"] * 28
    return {
        "metadata": {"system": "desk", "version": "2", "tags": [{"k": "a"}, {"k": "b"}]},
        "payload": {
            "records": [
                {
                    "ticket_id": f"T{i}", "user": {"tier": ["Free", "Pro", "Max"][i % 3], "tenure_months": i % 40},
                    "metrics": {"response_time_min": i * 0.5, "reopen_count": i % 4}, "priority": priorities[i],
                }
                for i in range(n)
            ]
        },
    }


def test_longest_nested_list_wins(spark, tmp_path):
    path = tmp_path / "tickets.json"
    path.write_text(json.dumps(tickets(), indent=1))
    df = readers.read_any(spark, str(path))
    assert set(df.columns) == {"ticket_id", "user.tier", "user.tenure_months", "metrics.response_time_min", "metrics.reopen_count", "priority"}
    counts = {r["priority"]: r["count"] for r in df.groupBy("priority").count().collect()}
    assert counts == {"High": 42, "Medium": 40, "Low": 40, "Critical": 28}


def test_json_shapes(spark, tmp_path):
    columns, records, single = tmp_path / "c.json", tmp_path / "r.json", tmp_path / "s.json"
    columns.write_text(json.dumps({"a": [1, 2, 3], "b": ["x", "y", "z"]}))
    records.write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}]))
    single.write_text(json.dumps({"a": 1, "b": {"c": 2}}))
    assert sorted(map(tuple, readers.read_any(spark, str(columns)).collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert readers.read_any(spark, str(records)).columns == ["a", "b.c"]
    assert readers.read_json(spark, str(single)).first().asDict() == {"a": 1, "b.c": 2}


@pytest.mark.parametrize("name, sep", [("d.csv", ","), ("d.csv", ";"), ("d.txt", "|"), ("d.tsv", "\t")])
def test_delimited(spark, tmp_path, name, sep):
    path = tmp_path / name
    lines = [sep.join(NAMES)] + [sep.join(map(str, r)) for r in ROWS]
    lines += [sep.join(map(str, ROWS[0])) + sep + "surplus", sep.join(["7", "Short"])]
    path.write_text("\n".join(lines))
    df = readers.read_any(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "double", "string"]
    assert df.count() == 101
    assert tuple(df.filter("department = 'Short'").first()) == (7, "Short", None, None, None)


def test_columnar_lines_and_xml(spark, tmp_path):
    df = spark.createDataFrame(ROWS, NAMES)
    sinks.write_table(df, str(tmp_path / "a.parquet"))
    sinks.write_table(df, str(tmp_path / "a.jsonl"), "json")
    df.write.option("rowTag", "row").option("rootTag", "rows").xml(str(tmp_path / "a.xml"))
    for name in ("a.parquet", "a.jsonl", "a.xml"):
        found = readers.read_any(spark, str(tmp_path / name)).select(*NAMES)
        assert sorted(map(tuple, found.collect())) == sorted(ROWS), name


def workbook(path, sheets: dict[str, list[list]]) -> None:
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>{tags}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        texts: list[str] = []
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for y, row in enumerate(rows, 1):
                body += f'<row r="{y}">'
                for x, v in enumerate(row):
                    ref = f"{chr(65 + x)}{y}"
                    if v is None:
                        continue
                    if isinstance(v, str):
                        texts.append(v)
                        body += f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'
                    else:
                        body += f'<c r="{ref}"><v>{v}</v></c>'
                body += "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


def test_workbook_picks_sheet_and_header(spark, tmp_path):
    data = [["Quarterly report", None, None, None], [None, None, None, None], ["Date", "Region", None, "Revenue"]]
    data += [[f"2024-01-{i + 1:02d}", "North", i, 10.5 * i] for i in range(28)]
    workbook(tmp_path / "sales.xlsx", {"notes": [["read me"]], "data": data})
    df = readers.read_any(spark, str(tmp_path / "sales.xlsx"))
    assert df.columns == ["Date", "Region", "col_2", "Revenue"]
    assert [t for _, t in df.dtypes] == ["timestamp_ntz", "string", "bigint", "double"] and df.count() == 28


def test_header_row_of_text_table(spark):
    rows = [(0, "Title", None, None), (1, "a", "b", None), (2, "1", "2", "3")]
    out = first_full_row_header(spark.createDataFrame(rows, "n int, x string, y string, z string"), "n")
    assert out.columns == ["a", "b", "col_2"] and tuple(out.first()) == ("1", "2", "3")


def test_tidy_names():
    assert readers.tidy_names([" a  b ", "", "x", "X", "x", "x_1"]) == ["a b", "column_1", "x", "X_1", "x_2", "x_1_1"]


def test_unusable_sources(spark, tmp_path):
    nulls = spark.createDataFrame([(None, None)] * 3, "a string, b string")
    with pytest.raises(readers.SourceError, match="missing values"):
        readers.tidy(nulls)
    with pytest.raises(readers.SourceError, match="at least 2 columns"):
        readers.tidy(spark.createDataFrame([(1.0,), (2.0,)], "Revenue double"))
    assert readers.tidy(spark.createDataFrame([(1.0,), (2.0,)], "Revenue double"), need_two_columns=False).count() == 2
    with pytest.raises(readers.SourceError, match="at least 2 rows"):
        readers.tidy(spark.createDataFrame([(1, 2)], "a int, b int"))
    with pytest.raises(readers.SourceError, match="no usable"):
        readers.tidy(spark.createDataFrame([], "a int, b int"))
    with pytest.raises(readers.SourceError, match="Unsupported"):
        readers.read_any(spark, str(tmp_path / "x.exe"))


def test_validation_by_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2")
    (tmp_path / "in" / "b.exe").write_text("x")
    (tmp_path / "in" / "c.csv").write_text("x" * 200)
    found = readers.validate_source(spark, str(tmp_path / "in"), max_bytes=100).collect()
    verdicts = {r["path"][-5:]: r["verdict"] for r in found}
    assert verdicts["a.csv"] == "ok" and verdicts["b.exe"].startswith("Unsupported") and verdicts["c.csv"].startswith("File size")


def test_stacking(spark):
    a, b = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    other = spark.range(9).toDF("y")
    assert readers.union_same_schema_or_largest([a, other, b]).count() == 8
    assert readers.union_same_schema_or_largest([a, other]).columns == ["y"]


def test_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.list().count() == 0
    insights = spark.createDataFrame([(1, "Churn is high", "rules"), (2, "Act now", "rules")], "item_id bigint, text string, source string")
    store.save("r1", "a.csv", target="Churn", user_id="A", model_card={"winner": "Ridge"}, insights=insights)
    store.save("r2", "b.csv", insights=insights)
    scored = spark.createDataFrame([(3.0, "Yes", 0.9)], "tenure double, prediction string, probability double")
    store.add_predictions("r1", scored, ["tenure"], ["prediction", "probability"])

    assert [r["run_id"] for r in store.list("A").collect()] == ["r1"]
    assert store.list("B").count() == 0 and store.list().count() == 2
    assert store.get("r1", "B") is None and store.get("r2", "B") is not None
    sections = sorted((r["section"], r["item_id"]) for r in store.document("r1", "A").collect() if r["section"] != "predictions")
    assert sections == [("insights", 1), ("insights", 2), ("run", 0)]
    assert json.loads(store.get("r1")["predictions"].first()["output"]) == {"prediction": "Yes", "probability": 0.9}

    assert not store.delete("r1", "B") and store.delete("r1", "A") and not store.delete("r1", "A")
    assert store.get("r1") is None and store.list().count() == 1
    copy = store.compact(str(tmp_path / "copy"))
    assert copy.table("insights").select("run_id").distinct().collect()[0]["run_id"] == "r2"
    assert copy.table("predictions").count() == 0


def test_reading_a_run_prunes_folders(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "many"))
    rows = spark.range(100).select(F.col("id").alias("item_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.col("id").cast("string").alias("run_id"))
    store.append("insights", rows)
    one = store.of_run("insights", "7")
    assert one.count() == 1 and len(one.inputFiles()) > 0
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().toString()


def test_quoted_cells_survive_both_ways(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,name,n\n1,"a ""x"", b",20\n2,"say ""hi""",21\n3,"two\nlines",22\n4,plain,23\n5,a,b,c\n')
    df = readers.read_delimited(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, 'a "x", b', 20), (2, 'say "hi"', 21), (3, "two\nlines", 22), (4, "plain", 23)]
    out = str(tmp_path / "out.csv")
    sinks.write_table(df, out, "csv")
    assert sorted(readers.read_any(spark, out).collect()) == sorted(df.collect())
    import csv
    import glob

    cells = [row for part in glob.glob(f"{out}/part-*") for row in csv.reader(open(part, newline=""))]
    assert ["1", 'a "x", b', "20"] in cells and ["3", "two\nlines", "22"] in cells


def test_a_malformed_record_is_refused(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    with pytest.raises(readers.SourceError, match="cannot be parsed"):
        readers.read_json_lines(spark, str(path))
    assert sorted(r["a"] for r in readers.read_json_lines(spark, str(path), bad="drop").collect()) == [1, 3]


def test_a_folder_of_documents_is_unpacked(spark, tmp_path):
    folder = tmp_path / "docs.json"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps(tickets(2 + i)))
    assert readers.read_json(spark, str(folder)).count() == 5


def test_one_layout_for_a_date_column(spark):
    df = spark.createDataFrame([("13/02/2024",), ("03/02/2024",), ("28/03/2024",), ("junk",), (None,)], "d string")
    found = [r["d"] for r in readers.parse_date_column(df, "d").collect()]
    assert [None if x is None else (x.day, x.month) for x in found] == [(13, 2), (3, 2), (28, 3), None, None]


def test_a_list_of_one_record_is_a_list(spark, tmp_path):
    (tmp_path / "one.json").write_text('\n [{"id": 1, "parts": [{"p": 1}, {"p": 2}]}]')
    (tmp_path / "two.json").write_text('[{"id": 1, "parts": [{"p": 1}, {"p": 2}]}, {"id": 2, "parts": []}]')
    (tmp_path / "object.json").write_text('{"id": 1, "parts": [{"p": 1}, {"p": 2}]}')
    read = lambda name: readers.read_json(spark, str(tmp_path / name))
    assert read("one.json").count() == 1 and read("two.json").count() == 2
    assert read("one.json").columns == read("two.json").columns and "p" in read("object.json").columns


def test_only_a_missing_table_of_the_store_is_empty(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.table("runs").count() == 0


def test_workbooks_keep_signs_types_and_blanks(spark, tmp_path):
    rows = [(1, "a & <b>", 1.5, True), (2, "_x0041_ \x01 tab\tline\nend\r", None, False), (None, "  spaced ", -2.0, None)]
    out = str(tmp_path / "books")
    assert W.write_workbooks(spark.createDataFrame(rows, "n long, t string, v double, b boolean").coalesce(1), out, 2) == 2
    cells = W.workbook_cells(spark, out)
    found = W.cells_to_table(W.promote_header(cells)).select("n", "t", "v", "b").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [("1", "a & <b>", "1.5", "true"), ("2", "_x0041_ \x01 tab\tline\nend\r", None, "false"), (None, "  spaced ", "-2.0", None)], key=str
    )
    assert [W._column_number(W._column_letters(i) + "1") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
    assert W.write_workbooks(spark.range(0), str(tmp_path / "none")) == 0


def test_a_repeated_save_adds_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    notes = spark.createDataFrame([(1, "a", "rules"), (2, "b", "rules")], "item_id bigint, text string, source string")
    store.stage("run", "died", insights=notes.withColumn("run_id", F.lit("r1")))
    assert store.get("r1") is None and store.table("insights").count() == 0
    for _ in range(2):
        store.save("r1", "a.csv", insights=notes)
    assert store.list().count() == 1 and store.table("insights").count() == 2 == store.get("r1")["insights"].count()

    # Two writers that both staged before either finished: the first to finish counts.
    head = store.table("runs").withColumn("run_id", F.lit("r2"))
    for attempt in ("x", "y"):
        store.stage("run", attempt, insights=notes.withColumn("run_id", F.lit("r2")), runs=head)
    for attempt in ("y", "x"):
        store.finish("run", attempt, head)
    assert store.get("r2")["insights"].count() == 2 and store.list().count() == 2

    scored = spark.createDataFrame([(3.0, "Yes")], "tenure double, prediction string")
    for _ in range(2):
        store.add_predictions("r1", scored, ["tenure"], ["prediction"], batch="monday")
    store.add_predictions("r1", scored, ["tenure"], ["prediction"])
    assert store.table("predictions").count() == 2

    copy = store.compact(str(tmp_path / "copy"))
    copy.save("r1", "a.csv", insights=notes)
    assert copy.table("insights").count() == 4 and copy.list().count() == 2 and copy.table("predictions").count() == 2


def test_cells_are_read_once_and_never_broadcast(spark):
    """The joins that find sheet, header and names send those, not the cells."""
    from pyspark.sql import functions as F

    from factloom.sources import workbook as W

    cells = spark.range(50).select(
        F.lit("a").alias("path"), F.lit("data").alias("sheet"), F.col("id").cast("int").alias("row"),
        F.posexplode(F.array(F.concat(F.lit("x"), F.col("id").cast("string")), F.col("id").cast("string"))).alias("col", "value"),
    )
    plan = W.promote_header(W.largest_sheet(cells))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert plan.count("Generate") == 1
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_sheets_are_dealt_over_all_tasks(spark, tmp_path):
    """Small files are not merged into a few tasks by their bytes."""
    W.write_workbooks(spark.range(40).repartition(8), str(tmp_path / "books"), 5)
    cells = W.workbook_cells(spark, str(tmp_path / "books"))
    assert "REPARTITION_BY_NUM" in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.where("row > 0").count() == 40
