"""Column kinds, quoting and null handling shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_EXPRESSIONS_PER_JOB = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers proper; boolean is categorical for models and charts."""
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))


def kind_of(dtype: T.DataType) -> str:
    """datetime / numerical / categorical; boolean counts as numerical when inspecting."""
    if is_temporal(dtype):
        return "datetime"
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return "numerical"
    return "categorical"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in skip
    ]


def clean_value(name: str, dtype: T.DataType) -> Column:
    """The column with NaN read as null, so counts and averages agree on what is missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None).cast(dtype))
    return col(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    changed = {
        f.name: clean_value(f.name, f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(changed) if changed else df


def as_double(df: DataFrame, name: str) -> Column:
    return clean_value(name, df.schema[name].dataType).cast("double")


def finite_double(value: Column) -> Column:
    """A double with NaN mapped to null."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def to_number(value: Column) -> Column:
    """Text to double, null when it is not a plain decimal number."""
    text = F.trim(value.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, text.try_cast("double"))


def fused_agg(df: DataFrame, exprs: Sequence[Column]) -> dict[str, object]:
    """Evaluate many global aggregates in as few scans as the code size limit allows."""
    out: dict[str, object] = {}
    for start in range(0, len(exprs), MAX_EXPRESSIONS_PER_JOB):
        row: Row = df.agg(*exprs[start : start + MAX_EXPRESSIONS_PER_JOB]).first()
        out.update(row.asDict())
    return out


def long_values(df: DataFrame, names: Sequence[str], cast: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value): the named columns unpivoted with a common type, nulls dropped."""
    if not names:
        return df.select(*[col(k) for k in keep], F.lit(None).cast("string").alias("column"), F.lit(None).cast(cast).alias("value")).where(F.lit(False))
    cells = [clean_value(n, df.schema[n].dataType).cast(cast).alias(n) for n in names]
    wide = df.select(*[col(k) for k in keep], *cells)
    return (
        wide.unpivot([col(k) for k in keep], [col(n) for n in names], "column", "value")
        .filter(F.col("value").isNotNull())
    )


def long_rows(wide: DataFrame, records: Sequence[tuple[str, Sequence[Column]]], fields: Sequence[str], key: str = "column") -> DataFrame:
    """Turn a one-row (or per-group) wide result into one row per record, inside the plan."""
    structs = [
        F.struct(F.lit(name).alias(key), *[c.alias(f) for c, f in zip(cells, fields)])
        for name, cells in records
    ]
    return wide.select(F.inline(F.array(*structs)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows that have both values; null where one of them is constant, in any error mode."""
    one, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(F.var_pop(one) * F.var_pop(other))
    return F.when(spread > 0, F.covar_pop(one, other) / spread)
