"""Spreadsheet files: cells are read per file in tasks, tables are formed by Spark."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import col
from factloom.operators.order import broadcast_if_small
from factloom.session import materialize

HEADER_ROWS, HEADER_SHARE = 30, 0.5
CELLS = "path string, sheet string, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Signs that XML cannot hold are written as _xHHHH_, and so is an underscore that begins such a form.
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _column_letters(number: int) -> str:
    letters = ""
    number += 1
    while number:
        number, digit = divmod(number - 1, 26)
        letters = chr(65 + digit) + letters
    return letters


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text(item) for item in root.iter(f"{_MAIN}si")]


def _text(node: ElementTree.Element) -> str:
    whole = "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
    return _CODED.sub(lambda m: chr(int(m.group(1), 16)), whole)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {
        r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    names = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[s.get(f"{_LINK}id")].lstrip("/")
        names.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return names


def _cells(path: str, content: bytes, sheet: str, member: str) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = _texts(book)
        with book.open(member) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_MAIN}row":
                    continue
                row = int(node.get("r")) - 1
                for cell in node.iter(f"{_MAIN}c"):
                    kind, raw = cell.get("t"), cell.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        raw = _text(cell)
                    elif kind == "s" and raw is not None:
                        raw = texts[int(raw)]
                    elif kind == "b" and raw is not None:
                        raw = "true" if raw == "1" else "false"
                    if raw not in (None, ""):
                        yield path, sheet, row, _column_number(cell.get("r")), raw
                node.clear()


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) for the non-empty cells of all workbooks under a path.

    The sheets are listed first; each (file, sheet) is then a row of its own that any task may read. The
    format bounds a sheet to 1,048,576 rows.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xls[xm]")
        .load(path)
        .select("path", "content")
    )

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    listed = [(file, content, sheet, member) for sheet, member in _sheets(book)]
                yield pd.DataFrame(listed, columns=["path", "content", "sheet", "member"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "row", "col", "value"]
        for part in parts:
            for file, content, sheet, member in zip(part["path"], part["content"], part["sheet"], part["member"]):
                batch: list[tuple] = []
                for cell in _cells(file, bytes(content), sheet, member):
                    batch.append(cell)
                    if len(batch) >= 10_000:
                        yield pd.DataFrame(batch, columns=names)
                        batch = []
                yield pd.DataFrame(batch, columns=names)

    sheets = files.mapInPandas(index, "path string, content binary, sheet string, member string")
    # A set number of tasks: parsing costs far more than the few bytes, by which they would be merged, tell.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sheets.repartition(tasks, "path", "sheet").mapInPandas(read, CELLS)


def _book(names: list[str], rows: list[tuple]) -> bytes:
    """One workbook with one sheet: a header row, then the rows; numbers as numbers, all else as text."""
    letters = [_column_letters(i) for i in range(len(names))]

    def cell(at: str, value: object) -> str:
        if value is None or value != value:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)) and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        text = _UNSAFE.sub(lambda m: f"_x{ord(m.group()):04X}_", str(value))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = [
        f'<row r="{i}">' + "".join(cell(f"{letter}{i}", v) for letter, v in zip(letters, row)) + "</row>"
        for i, row in enumerate([tuple(names), *rows], 1)
    ]
    space, link = _MAIN[1:-1], _LINK[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    members = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{link}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in members.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def write_workbooks(df: DataFrame, path: str, rows_per_file: int = 50_000) -> int:
    """Write a table as a folder of workbooks of at most ``rows_per_file`` rows; the number of files.

    A file is named after its partition and place and moved there when whole, so a repeated task
    replaces it. ``path`` is a folder that all executors can write to.
    """
    names, (target, root) = df.columns, _filesystem(path)
    target.create_dir(root, recursive=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(path)
        task = TaskContext.get()
        rows: list[tuple] = []
        written = 0

        def put() -> None:
            name = f"{folder}/part-{task.partitionId():05d}-{written:05d}"
            draft = f"{name}.{task.taskAttemptId()}.draft"
            with files.open_output_stream(draft) as out:
                out.write(_book(names, rows))
            files.move(draft, f"{name}.xlsx")

        for part in parts:
            for row in zip(*[c.to_pylist() for c in part.columns]):
                rows.append(row)
                if len(rows) == rows_per_file:
                    put()
                    rows, written = [], written + 1
        if rows:
            put()
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    return df.mapInArrow(run, "files long").agg(F.sum("files").alias("n")).first()["n"] or 0


def _filesystem(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def largest_sheet(cells: DataFrame) -> DataFrame:
    """Only the cells of the sheet with the largest area, per file."""
    areas = cells.groupBy("path", "sheet").agg(((F.max("row") + 1) * (F.max("col") + 1)).alias("area"))
    best = areas.groupBy("path").agg(F.min_by("sheet", F.struct(-F.col("area"), F.col("sheet"))).alias("sheet"))
    return cells.join(broadcast_if_small(materialize(best, "sheets")), ["path", "sheet"])


def promote_header(cells: DataFrame) -> DataFrame:
    """(path, row, col, name, value): the first of 30 rows that is at least half full names the columns.

    Widths, headers and names are written before they meet the cells, so no join repeats a pass over them.
    """
    top = materialize(cells.filter(F.col("row") < HEADER_ROWS).select("path", "row", "col", "value"), "tops")
    widths = cells.groupBy("path").agg((F.max("col") + 1).alias("width"))
    heads = (
        top.groupBy("path", "row")
        .agg(F.count("value").alias("filled"))
        .join(widths, "path")
        .withColumn("_full", F.when(F.col("filled") / F.col("width") >= HEADER_SHARE, F.col("row")))
        .groupBy("path")
        .agg(F.coalesce(F.min("_full"), F.lit(0)).alias("head"))
    )
    heads = broadcast_if_small(materialize(heads, "heads"))
    first = top.join(heads, "path").filter(F.col("row") == F.col("head"))
    names = broadcast_if_small(materialize(first.select("path", "col", F.trim("value").alias("name")), "names"))
    body = cells.join(heads, "path").filter(F.col("row") > F.col("head"))
    named = body.join(names, ["path", "col"], "left")
    return named.select(
        "path", "row", "col", F.coalesce("name", F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("name"), "value"
    )


def cells_to_table(named: DataFrame) -> DataFrame:
    """Named cells to one row per file and row; columns by name over all files."""
    names = [r["name"] for r in named.groupBy("name").agg(F.min("col").alias("c")).orderBy("c", "name").collect()]
    picked = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return named.groupBy("path", "row").agg(*picked)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The largest sheet of each workbook as one typed table."""
    from factloom.sources.readers import SourceError, infer_types

    cells = materialize(workbook_cells(spark, path), "cells")  # every sheet is parsed once
    if not cells.limit(1).count():
        raise SourceError("The Excel file has no sheets with data.")
    table = cells_to_table(promote_header(largest_sheet(cells)))
    return infer_types(materialize(table.drop("path", "row"), "sheet-rows"))


def first_full_row_header(df: DataFrame, order: str) -> DataFrame:
    """The same header rule for a raw text table whose rows carry an order column."""
    data = [c for c in df.columns if c != order]
    share = sum((F.when(F.trim(col(c)) != "", 1).otherwise(0) for c in data), F.lit(0)) / F.lit(len(data))
    top = df.orderBy(order).limit(HEADER_ROWS)
    head = top.filter(share >= HEADER_SHARE).orderBy(order).limit(1).first() or top.first()
    names = [(head[c] or "").strip() or f"col_{i}" for i, c in enumerate(data)]
    return df.filter(F.col(order) > head[order]).select(*[col(c).alias(n) for c, n in zip(data, names)])
