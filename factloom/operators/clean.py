"""Cleaning: duplicates, coercion, trimming, dates, imputation, and the report.

The plan is settled by a few aggregate jobs; the cleaned table itself stays a
single lazy projection over the source.
"""

from __future__ import annotations

import re

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import (
    clean_value,
    col,
    finite_double,
    fused_agg,
    is_nested,
    is_numeric,
    is_temporal,
    to_number,
)
from factloom.operators.order import column_quantiles
from factloom.operators.profile import duplicate_summary, looks_like_id, modes
from factloom.session import materialize

# Thresholds, name rules and accepted date layouts.
NUMERIC_SHARE = 0.8
DATE_SHARE = 0.5
CLEAN_ID_SUFFIXES = ("id", "uuid", "guid", "key")
DATE_WORDS = ("date", "time")
DATE_LAYOUTS = (
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "M/d/yyyy",
    "MM-dd-yyyy",
    "dd-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "dd/MM/yyyy",
    "d/M/yyyy",
    "dd-MM-yyyy",
)


@dataclass
class CleanPlan:
    """What cleaning will do, decided from aggregates only."""

    rows_before: int
    rows_after: int
    columns: int
    numeric: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    layouts: dict[str, str] = field(default_factory=dict)
    trimmed: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    filled_nulls: dict[str, int] = field(default_factory=dict)
    nulls_remaining: int = 0
    steps: list[str] = field(default_factory=list)


ISO = "iso"


def layout_shape(layout: str) -> str:
    """A pattern that every value of the layout fits: letters for a month's name, digits elsewhere, the signs between.

    A failing parse costs far more than a failing match, so values of another shape are never parsed.
    """
    def part(found: re.Match) -> str:
        run = found.group()
        if not run[0].isalpha():
            return re.escape(run)
        if run == "MMM":
            return r"\p{L}+"
        return "[0-9]{2}" if len(run) == 2 else "[+-]?[0-9]+"

    return "^" + re.sub(r"([A-Za-z])\1*|[^A-Za-z]+", part, layout) + "$"


def parse_layout(value: Column, layout: str) -> Column:
    """Text to timestamp in one layout, null where it does not fit."""
    text = F.trim(value.cast("string"))
    if layout == ISO:
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?"), text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(layout_shape(layout)), F.try_to_timestamp(text, F.lit(layout))).cast("timestamp_ntz")


def parse_timestamp(value: Column) -> Column:
    """Text to timestamp over the fixed list of layouts, null when none fits; for the test whether a value is a date at all."""
    return F.coalesce(*[parse_layout(value, p) for p in (ISO, *DATE_LAYOUTS)])


def _layout_counts(names: list[str]) -> list[Column]:
    return [F.count(parse_layout(col(c), p)).alias(f"_ts{i}_{k}") for i, c in enumerate(names) for k, p in enumerate((ISO, *DATE_LAYOUTS))]


def _layouts_from(seen: dict, names: list[str]) -> dict[str, tuple[str, int]]:
    """Per column the layout that fits most values, the first of equals, and how many it fits."""
    out = {}
    for i, c in enumerate(names):
        fits = [(seen[f"_ts{i}_{k}"], -k) for k in range(len(DATE_LAYOUTS) + 1)]
        n, k = max(fits)
        out[c] = ((ISO, *DATE_LAYOUTS)[-k], n)
    return out


def best_layouts(df: DataFrame, names: list[str]) -> dict[str, tuple[str, int]]:
    """One layout per column, so that a column is never read in two orders of day and month."""
    return _layouts_from(fused_agg(df, _layout_counts(names)), names) if names else {}


def date_named(name: str) -> bool:
    return any(word in name.lower() for word in DATE_WORDS)


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def drop_duplicate_rows(df: DataFrame) -> tuple[DataFrame, int, int]:
    """(table, rows before, rows after). Rows are shuffled only if duplicates exist."""
    summary = duplicate_summary(df)
    if not summary["repeats"]:
        return df, summary["rows"], summary["rows"]
    kept = materialize(df.dropDuplicates(), "distinct")
    return kept, summary["rows"], kept.count()


def _coerced(name: str, dtype: T.DataType, plan: CleanPlan) -> Column:
    if name in plan.numeric:
        return to_number(col(name))
    if name in plan.dates:
        if isinstance(dtype, T.StringType):
            return parse_layout(col(name), plan.layouts[name])
        return col(name).cast("timestamp_ntz") if isinstance(dtype, T.DateType) else col(name)
    if isinstance(dtype, T.StringType):
        return F.trim(col(name))
    return clean_value(name, dtype)


def plan_cleaning(df: DataFrame, rows_before: int, rows_after: int) -> CleanPlan:
    plan = CleanPlan(rows_before, rows_after, len(df.columns))
    if rows_after < rows_before:
        plan.steps.append(f"Removed {rows_before - rows_after} duplicate rows")

    texts = _texts(df)
    aggs: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count(clean_value(f.name, f.dataType)).alias(f"n{i}"))
        if f.name in texts:
            if not looks_like_id(f.name, CLEAN_ID_SUFFIXES):
                aggs.append(F.count(to_number(col(f.name))).alias(f"num{i}"))
    dated = [c for c in texts if date_named(c)]
    seen = fused_agg(df, aggs + _layout_counts(dated))
    layouts = _layouts_from(seen, dated)

    non_null: dict[str, int] = {}
    late_steps: list[str] = []
    for i, f in enumerate(df.schema.fields):
        present = seen[f"n{i}"]
        non_null[f.name] = present
        guarded = looks_like_id(f.name, CLEAN_ID_SUFFIXES)
        if is_temporal(f.dataType):
            if not guarded and present:
                plan.dates.append(f.name)
                plan.steps.append(f"Recognised '{f.name}' as datetime")
            if date_named(f.name) and present > DATE_SHARE * rows_after:
                late_steps.append(f"Converted '{f.name}' to datetime")
            continue
        if f.name not in texts:
            continue
        parsed = seen.get(f"num{i}", 0)
        if not guarded and present and parsed / present >= NUMERIC_SHARE:
            plan.numeric.append(f.name)
            plan.steps.append(f"Converted '{f.name}' to numeric")
            non_null[f.name] = parsed
            continue
        plan.trimmed.append(f.name)
        layout, fitting = layouts.get(f.name, (ISO, 0))
        if rows_after and fitting / rows_after > DATE_SHARE:
            plan.dates.append(f.name)
            plan.layouts[f.name] = layout
            late_steps.append(f"Converted '{f.name}' to datetime")
            non_null[f.name] = fitting
    plan.steps += late_steps

    types = {f.name: f.dataType for f in df.schema.fields}
    holes = {c: rows_after - n for c, n in non_null.items() if rows_after > n}
    numeric = [c for c in holes if c in plan.numeric or is_numeric(types[c])]
    others = [c for c in holes if c not in numeric and not is_nested(types[c])]
    coerced = df.select(*[_coerced(f.name, f.dataType, plan).alias(f.name) for f in df.schema.fields])
    medians = column_quantiles(coerced, numeric, {"median": 0.5})
    common = modes(coerced, others)
    for c in df.columns:
        if c in numeric:
            value = medians.get(c, {}).get("median")
            plan.fills[c] = 0.0 if value is None else value
            plan.steps.append(f"Filled {holes[c]} nulls in '{c}' with median ({plan.fills[c]:.2f})")
        elif c in others:
            is_text = isinstance(types[c], T.StringType) and c not in plan.dates
            value = common.get(c, "Unknown" if is_text else None)
            if value is None:
                plan.nulls_remaining += holes[c]
                continue
            plan.fills[c] = value
            plan.steps.append(f"Filled {holes[c]} nulls in '{c}' with mode ('{value}')")
        elif c in holes:
            plan.nulls_remaining += holes[c]
            continue
        if c in holes:
            plan.filled_nulls[c] = holes[c]
    if not plan.steps:
        plan.steps.append("Data was already clean — no changes needed!")
    return plan


def apply_plan(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """The cleaned table as one projection; also valid on new rows of the same shape."""
    out = []
    for f in df.schema.fields:
        value = _coerced(f.name, f.dataType, plan)
        if f.name in plan.fills:
            fill = plan.fills[f.name]
            if f.name in plan.numeric or is_numeric(f.dataType):
                value = F.coalesce(finite_double(value), F.lit(float(fill)))
            elif f.name in plan.dates or is_temporal(f.dataType):
                value = F.coalesce(value, F.lit(fill).cast("timestamp_ntz"))
            elif isinstance(f.dataType, T.BooleanType):
                value = F.coalesce(value, F.lit(fill).cast("boolean"))
            else:
                value = F.coalesce(value, F.lit(fill))
        out.append(value.alias(f.name))
    return df.select(*out)


def clean(df: DataFrame) -> tuple[DataFrame, CleanPlan]:
    kept, before, after = drop_duplicate_rows(df)
    plan = plan_cleaning(kept, before, after)
    return apply_plan(kept, plan), plan


def clean_report(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """Report rows (section, position, detail) for a cleaning plan."""
    rows = [
        ("original_shape", 0, f"{plan.rows_before} x {plan.columns}"),
        ("cleaned_shape", 0, f"{plan.rows_after} x {plan.columns}"),
        ("nulls_remaining", 0, str(plan.nulls_remaining)),
        *[("step", i, text) for i, text in enumerate(plan.steps, 1)],
    ]
    return df.sparkSession.createDataFrame(rows, "section string, position int, detail string")


def coerce_money(df: DataFrame, name: str) -> DataFrame:
    """One amount column held as text: to number, blanks and junk to the median."""
    numbers = df.withColumn(name, to_number(col(name)))
    median = column_quantiles(numbers, [name], {"median": 0.5}).get(name, {}).get("median", 0.0)
    return numbers.withColumn(name, F.coalesce(col(name), F.lit(float(median))))
