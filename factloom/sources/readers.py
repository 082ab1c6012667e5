"""Files to tables: one entry point, tidy names, flattened JSON, tolerant CSV."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import clean_value, col, fused_agg, nan_to_null
from factloom.operators.clean import best_layouts, parse_layout

# Extensions, delimiters, and limits of the upload check.
DELIMITED = (".csv", ".tsv", ".txt")
SUPPORTED = (
    ".csv", ".tsv", ".txt", ".xlsx", ".xlsm", ".json", ".jsonl", ".ndjson", ".parquet", ".xml",
)
UPLOAD_EXTENSIONS = (".csv", ".xlsx", ".xls", ".json")
UPLOAD_BYTES = 20 * 1024 * 1024
DELIMITERS = (",", ";", "\t", "|")
EXTRA = "_extra_field"


class SourceError(ValueError):
    """The source cannot be read as a table; the message is for the user."""


def extension_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/").lower())[1]


# Quoted cells, a doubled quote inside them standing for one.
QUOTES = {"quote": '"', "escape": '"'}
# A doubled quote ends one quoted part and begins the next, so one class without alternatives is enough.
QUOTED_CELL = r'"[^"]*"'


def delimited_shape(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, bool]:
    """(delimiter, whether records may span lines), from one aggregate over all lines.

    The delimiter is the one whose field count outside quotes is most even; comma when unclear. Only a
    line with an odd number of quotes can open or close a record that spans lines, and without such a
    line a file can be split between tasks.
    """
    lines = spark.read.option("encoding", encoding).text(path).filter(F.trim("value") != "")
    bare = F.regexp_replace("value", QUOTED_CELL, "")
    counts = [F.struct(F.lit(d).alias("d"), (F.size(F.split(bare, re.escape(d))) - 1).alias("n")) for d in DELIMITERS]
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2
    rows = (
        lines.select(odd.alias("odd"), F.explode(F.array(*counts)).alias("c"))
        .groupBy("c.d", "c.n")
        .agg(F.count(F.lit(1)).alias("lines"), F.max("odd").alias("odd"))
        .collect()
    )
    best = max((r for r in rows if r["n"] > 0), key=lambda r: (r["lines"], r["n"], -DELIMITERS.index(r["d"])), default=None)
    return best["d"] if best else ",", any(r["odd"] for r in rows)


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", infer: bool = True
) -> DataFrame:
    """Delimited text with a header. Rows with too many fields go, short rows are padded with nulls."""
    found, spans = delimited_shape(spark, path, encoding)
    sep = sep or ("\t" if extension_of(path) == ".tsv" else found)
    options = {"sep": sep, "header": True, "encoding": encoding, "multiLine": spans, "mode": "PERMISSIVE", **QUOTES}
    head = spark.read.options(**options, inferSchema=False).csv(path)
    if not head.columns:
        raise SourceError("The delimited file is empty.")
    # Inference would let a bad line widen a column, so types are settled on the good rows.
    shape = T.StructType([T.StructField(c, T.StringType()) for c in [*head.columns, EXTRA]])
    rows = spark.read.options(**options).schema(shape).csv(path)
    good = rows.filter(F.col(EXTRA).isNull()).drop(EXTRA)
    return infer_types(good) if infer else good


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to long, double, boolean or timestamp when every value fits, in one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs: list[Column] = []
    for i, name in enumerate(texts):
        value = F.when(F.trim(col(name)) != "", F.trim(col(name)))
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"l{i}"),
            F.count_if(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")).alias(f"d{i}"),
            F.count_if(F.lower(value).isin("true", "false")).alias(f"b{i}"),
            F.count_if(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$") & value.try_cast("timestamp_ntz").isNotNull()).alias(f"t{i}"),
        ]
    seen = fused_agg(df, aggs)
    casts: dict[str, Column] = {}
    for i, name in enumerate(texts):
        n = seen[f"n{i}"]
        value = F.when(F.trim(col(name)) != "", F.trim(col(name)))
        for key, dtype in (("l", "bigint"), ("d", "double"), ("b", "boolean"), ("t", "timestamp_ntz")):
            if n and seen[f"{key}{i}"] == n:
                casts[name] = value.try_cast(dtype)
                break
    return df.withColumns(casts) if casts else df


def _struct_fields(schema: T.StructType, prefix: Sequence[str] = ()) -> list[tuple[list[str], T.DataType]]:
    out: list[tuple[list[str], T.DataType]] = []
    for f in schema.fields:
        path = [*prefix, f.name]
        if isinstance(f.dataType, T.StructType):
            out += _struct_fields(f.dataType, path)
        else:
            out.append((path, f.dataType))
    return out


def _path(parts: Sequence[str]) -> Column:
    value = col(parts[0])
    for p in parts[1:]:
        value = value.getField(p)
    return value


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to dotted column names."""
    return df.select(*[_path(p).alias(".".join(p)) for p, _ in _struct_fields(df.schema)])


def _record_lists(schema: T.StructType, prefix: Sequence[str] = ()) -> list[list[str]]:
    """Paths of arrays of objects reachable through objects."""
    out = []
    for f in schema.fields:
        path = [*prefix, f.name]
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(path)
        elif isinstance(f.dataType, T.StructType):
            out += _record_lists(f.dataType, path)
    return out


def _is_column_object(df: DataFrame) -> bool:
    """Objects whose values are all lists of plain values, of equal length within an object."""
    plain = all(
        isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)
        for f in df.schema.fields
    )
    if not plain:
        return False
    sizes = F.array_distinct(F.array(*[F.size(col(c)) for c in df.columns]))
    return bool(df.agg(F.bool_and(F.size(sizes) == 1).alias("even")).first()["even"])


def unpack_columns(df: DataFrame) -> DataFrame:
    """Objects of equally long lists to rows, one column per list."""
    return df.select(F.inline(F.arrays_zip(*[col(c) for c in df.columns]))).toDF(*df.columns)


def unpack_records(df: DataFrame, documents: bool = True) -> DataFrame:
    """The longest embedded list of objects as rows; without one, the objects themselves.

    With ``documents`` every row is a document of its own; otherwise rows are records, which stay rows.
    """
    if _is_column_object(df):
        return unpack_columns(df)
    paths = _record_lists(df.schema)
    if not paths or not documents:
        return flatten(df)
    sizes = fused_agg(df, [F.sum(F.size(_path(p))).alias(f"s{i}") for i, p in enumerate(paths)])
    best = max(range(len(paths)), key=lambda i: (sizes[f"s{i}"] or 0, -i))
    return flatten(df.select(F.inline(_path(paths[best]))))


CORRUPT = "_unreadable_json"


def _json(spark: SparkSession, path: str, encoding: str, bad: str, **options: bool) -> DataFrame:
    """Parsed objects. ``bad``: 'raise' on a malformed one, or 'drop' it."""
    raw = spark.read.options(encoding=encoding, columnNameOfCorruptRecord=CORRUPT, **options).json(path)
    if CORRUPT not in raw.columns:
        found = raw
    elif bad == "drop" and len(raw.columns) > 1:
        # Spark wants other columns read beside the malformed text, hence the schema without it and the mode.
        shape = T.StructType([f for f in raw.schema.fields if f.name != CORRUPT])
        found = spark.read.options(encoding=encoding, mode="DROPMALFORMED", **options).schema(shape).json(path)
    else:
        raise SourceError("Invalid JSON format: at least one record cannot be parsed.")
    if not found.columns:
        raise SourceError("Invalid JSON format or empty document.")
    return found


def read_json(spark: SparkSession, path: str, encoding: str = "UTF-8", bad: str = "raise") -> DataFrame:
    """JSON documents: a list of records, an object of columns, or records nested anywhere inside.

    A folder in which every file is one object holds documents, whose records are stacked; records of a
    list, also of a list of one, stay as they are.
    """
    raw = _json(spark, path, encoding, bad, multiLine=True)
    # A list of one record is a list, as its first sign shows.
    first = F.regexp_extract("value", r"^[\s\ufeff]*(.)", 1)
    listed = spark.read.text(path, wholetext=True).agg(F.max(first == "[").alias("listed")).first()["listed"]
    files = raw.select(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files")).first()
    return unpack_records(raw, not listed and files["rows"] == files["files"])


def read_json_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", bad: str = "raise") -> DataFrame:
    return flatten(_json(spark, path, encoding, bad))


def payload_shape(payloads: DataFrame, column: str) -> str:
    """The merged type of JSON texts, found by one aggregate over all of them."""
    merged = payloads.agg(F.schema_of_variant_agg(F.try_parse_json(col(column))).alias("s")).first()["s"]
    return re.sub(r"\bOBJECT<", "STRUCT<", merged).replace(": VOID", ": STRING").replace("<VOID>", "<STRING>")


def records_from_payload(payloads: DataFrame, column: str) -> DataFrame:
    """Rows held as JSON text in one column of a table."""
    parsed = payloads.select(F.from_json(col(column), payload_shape(payloads, column)).alias("r"))
    return flatten(parsed.select("r.*"))


def read_xml(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    return flatten(spark.read.option("rowTag", row_tag).xml(path))


def tidy_names(names: Sequence[str]) -> list[str]:
    """Single spaces, a name for blanks, a number for repeats (also when only case differs)."""
    out: list[str] = []
    seen: dict[str, int] = {}
    taken: set[str] = set()
    for i, raw in enumerate(names):
        name = re.sub(r"\s+", " ", str(raw)).strip() or f"column_{i}"
        key = name.lower()
        if key in seen or key in taken:
            count = seen.get(key, 0)
            while True:
                count += 1
                if f"{key}_{count}" not in taken:
                    break
            seen[key] = count
            name = f"{name}_{count}"
        else:
            seen[key] = 0
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(df: DataFrame, need_two_columns: bool = True) -> DataFrame:
    """Clean names, no empty columns or rows, dates recognised; raises for unusable tables."""
    if not df.columns:
        raise SourceError("The file contains no usable tabular data or rows.")
    df = nan_to_null(df.toDF(*tidy_names(df.columns)))
    counts = fused_agg(
        df,
        [F.count(F.lit(1)).alias("_rows")]
        + [F.count(clean_value(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    if not counts["_rows"]:
        raise SourceError("The file contains no usable tabular data or rows.")
    kept = [f.name for i, f in enumerate(df.schema.fields) if counts[f"n{i}"]]
    if not kept:
        raise SourceError("The file contains 100% missing values or no usable data.")
    if need_two_columns and len(kept) < 2:
        raise SourceError(f"The dataset must contain at least 2 columns for analysis (found {len(kept)}).")
    out = df.select(*[col(c) for c in kept])
    if not any(counts[f"n{df.columns.index(c)}"] == counts["_rows"] for c in kept):
        # Without a complete column some rows may be empty.
        out = out.dropna("all")
    rows = out.limit(2).count()
    if need_two_columns and rows < 2:
        raise SourceError(f"The dataset must contain at least 2 rows of data (found {rows}).")
    dates = {f.name: col(f.name).cast("timestamp_ntz") for f in out.schema.fields if isinstance(f.dataType, T.DateType)}
    return out.withColumns(dates) if dates else out


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """A tidy table from any supported file or folder; the extension decides unless ``fmt`` does."""
    from factloom.sources.workbook import read_workbooks

    ext = f".{fmt.lstrip('.')}" if fmt else extension_of(path)
    if ext not in SUPPORTED:
        raise SourceError(f"Unsupported file type '{ext}'. Supported: {', '.join(SUPPORTED)}")
    encoding = options.get("encoding", "UTF-8")
    try:
        if ext in DELIMITED:
            sep = options.get("sep") or ("\t" if ext == ".tsv" else None)
            df = read_delimited(spark, path, sep, encoding)
        elif ext == ".json":
            df = read_json(spark, path, encoding)
        elif ext in (".jsonl", ".ndjson"):
            df = read_json_lines(spark, path, encoding)
        elif ext == ".parquet":
            df = spark.read.parquet(path)
        elif ext == ".xml":
            df = read_xml(spark, path, options.get("row_tag", "row"))
        else:
            df = read_workbooks(spark, path)
    except AnalysisException as exc:
        raise SourceError(f"Failed to parse file '{path}': {exc.getCondition() or exc}") from exc
    return tidy(df)


def validate_source(
    spark: SparkSession, path: str, allowed: Sequence[str] = UPLOAD_EXTENSIONS, max_bytes: int = UPLOAD_BYTES
) -> DataFrame:
    """(path, extension, bytes, verdict) per file, from file metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    verdict = (
        F.when(~ext.isin(*allowed), F.concat(F.lit("Unsupported file extension '"), ext, F.lit("'.")))
        .when(F.col("length") == 0, "Uploaded file is empty.")
        .when(F.col("length") > max_bytes, F.lit(f"File size exceeds maximum allowed limit of {max_bytes // 2**20} MB."))
        .otherwise("ok")
    )
    return files.select("path", ext.alias("extension"), F.col("length").alias("bytes"), verdict.alias("verdict"))


def union_same_schema_or_largest(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables with the first one's header stacked; when it stands alone, the longest table."""
    if not frames:
        raise SourceError("No tables could be found.")
    same = [f for f in frames if f.columns == frames[0].columns]
    if len(same) == 1:
        counts = [f.count() for f in frames]
        return frames[counts.index(max(counts))]
    out = same[0]
    for f in same[1:]:
        out = out.unionByName(f)
    return out


def parse_date_column(df: DataFrame, name: str) -> DataFrame:
    """A text column to timestamps, in the one layout that fits most of its values."""
    return df.withColumn(name, parse_layout(col(name), best_layouts(df, [name])[name][0]))
