"""Inspection: shape, kinds, missing values, duplicates, ids, targets, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import (
    as_double,
    clean_value,
    col,
    fused_agg,
    is_nested,
    is_numeric,
    kind_of,
    long_rows,
    long_values,
    numeric_columns,
)
from factloom.operators.order import broadcast_if_small, exact_quantiles
from factloom.session import materialize

# Name rules that results depend on.
ID_SUFFIXES = ("id", "uuid", "guid", "key", "index")
ID_RATIO = 0.6
TARGET_NAMES_BY_TYPE = {
    "churn": ["churn", "churned", "attrition", "left"],
    "sales": ["revenue", "sales", "amount", "profit"],
    "fraud": ["fraud", "is_fraud", "anomaly"],
    "hr": ["attrition", "resigned", "terminated", "left"],
}
GENERIC_TARGET_NAMES = ["target", "label", "class", "outcome", "result", "status"]
FALLBACK_TARGET_NAMES = ["churn", "fraud", "attrition", "sales", "revenue"]

# A sketch above this estimate cannot hide a true count of 50 or fewer.
SURELY_MANY = 1_000
# A distinct sketch of 2^14 registers has a relative standard deviation below 0.01; six of them an estimate may be off before the exact count decides.
SKETCH_LOG_SIZE, SKETCH_SPREAD, SKETCH_MARGIN = 14, 0.01, 6
# So many pairs of hashes of repeated rows may be sent to all tasks.
SHARED_HASHES = 1_000_000


def looks_like_id(name: str, suffixes: Sequence[str] = ID_SUFFIXES) -> bool:
    return name.lower().endswith(tuple(suffixes))


def table_shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
    )


def missing_values(df: DataFrame) -> DataFrame:
    """One row per column: kind, type, nulls and their share of the rows."""
    cells = {f.name: clean_value(f.name, f.dataType) for f in df.schema.fields}
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(c.isNull()).alias(f"_m{i}") for i, c in enumerate(cells.values())],
    )
    records = [
        (
            f.name,
            [
                F.lit(kind_of(f.dataType)),
                F.lit(f.dataType.simpleString()),
                F.col(f"_m{i}"),
                F.col(f"_m{i}") / F.greatest(F.col("_n"), F.lit(1)),
            ],
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return long_rows(wide, records, ["kind", "dtype", "nulls", "share"])


def high_missing(df: DataFrame, share: float = 0.2) -> DataFrame:
    return missing_values(df).filter(F.col("share") > share).select("column", "nulls", "share")


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all cells; null flags keep shifted nulls apart."""
    cells: list[Column] = []
    for f in df.schema.fields:
        cells += [clean_value(f.name, f.dataType), col(f.name).isNull()]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)]


def duplicate_summary(df: DataFrame) -> dict[str, int]:
    """Row count and whether duplicates may exist, shuffling 16 bytes per row.

    Equal rows have equal hashes, so zero here proves there are none.
    """
    first, second = row_hashes(df)
    counts = df.select(first.alias("a"), second.alias("b")).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    row = counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats")).first()
    return {"rows": row["rows"] or 0, "repeats": row["repeats"] or 0}


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct rows and duplicates (nulls compare equal).

    Sixteen bytes per row are grouped first. Equal rows have equal hashes, so rows whose hash is alone
    are distinct, and only rows that share one are compared as a whole.
    """
    a, b = row_hashes(df)
    cells = [clean_value(f.name, f.dataType).alias(f.name) for f in df.schema.fields]
    hashed = df.select(F.struct(*cells).alias("_row"), a.alias("_a"), b.alias("_b"))
    counts = materialize(hashed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")), "hashes")
    alone = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count_if(F.col("_n") == 1).alias("_alone"))
    shared = broadcast_if_small(counts.where("_n > 1").select("_a", "_b"), SHARED_HASHES)
    compared = hashed.join(shared, ["_a", "_b"], "left_semi").groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("_groups"))
    # Two tables of one row each.
    both = alone.join(F.broadcast(compared)).withColumn("distinct_rows", F.col("_alone") + F.col("_groups"))
    return both.select("row_count", "distinct_rows", (F.col("row_count") - F.col("distinct_rows")).alias("duplicates"))


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column: two-phase, hot values combine map-side."""
    kept = [n for n in names if not is_nested(df.schema[n].dataType)]
    pairs = long_values(df, kept, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("non_null")
    )


def exact_distinct(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    if not names:
        return {}
    found = {r["column"]: r["distinct_values"] for r in distinct_counts(df, names).collect()}
    return {n: found.get(n, 0) for n in names}


def bounded_distinct(
    df: DataFrame, names: Sequence[str], rows: int | None = None, ratios: Sequence[float] = (), few: int = 0
) -> dict[str, int]:
    """Distinct non-null values per column, exact wherever a limit could hang on it.

    One scan sketches all columns. A column is counted exactly if it may have ``few`` values or less, which
    collapse before the shuffle, or if its share of the rows lies within the sketch's error of one of
    ``ratios``. Any other estimate is on the same side of every limit as the true count. Nested columns count 0.
    """
    kept = [n for n in names if not is_nested(df.schema[n].dataType)]
    if not kept:
        return dict.fromkeys(names, 0)
    # One buffer a column; approx_count_distinct at this spread would plan 1,600 of them for each.
    texts = [clean_value(n, df.schema[n].dataType).cast("string") for n in kept]
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(t, SKETCH_LOG_SIZE)).alias(f"d{i}") for i, t in enumerate(texts)]
    seen = fused_agg(df, [F.count(F.lit(1)).alias("n"), *sketches])
    total = max(seen["n"] if rows is None else rows, 1)
    margin = SKETCH_SPREAD * SKETCH_MARGIN
    close = []
    for i, n in enumerate(kept):
        least, most = seen[f"d{i}"] / (1 + margin), seen[f"d{i}"] / (1 - margin)
        if least <= few or any(least <= limit * total <= most for limit in ratios):
            close.append(n)
    estimates = {n: seen[f"d{i}"] for i, n in enumerate(kept)}
    return dict.fromkeys(names, 0) | estimates | exact_distinct(df, close)


def id_columns(df: DataFrame, suffixes: Sequence[str] = ID_SUFFIXES) -> DataFrame:
    """Per column: name test, exact distinct ratio, and the verdict."""
    named = F.lit(False)
    for suffix in suffixes:
        named = named | F.lower("column").endswith(suffix)
    total = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return distinct_counts(df, df.columns).select(
        "column",
        "distinct_values",
        (F.col("distinct_values") / F.greatest(total, F.lit(1))).alias("ratio"),
        named.alias("id_name"),
    ).withColumn("is_id", F.col("id_name") & (F.col("ratio") > ID_RATIO))


def id_column_names(df: DataFrame, rows: int, suffixes: Sequence[str] = ID_SUFFIXES) -> list[str]:
    named = [c for c in df.columns if looks_like_id(c, suffixes)]
    found = bounded_distinct(df, named, rows, ratios=[ID_RATIO])
    return [c for c in named if found[c] / max(rows, 1) > ID_RATIO]


def few_valued(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of the columns that may have few values.

    One sketch pass rules out the others, so the exact pass shuffles only
    columns whose values collapse map-side.
    """
    kept = [n for n in names if not is_nested(df.schema[n].dataType)]
    if not kept:
        return {}
    sketch = fused_agg(
        df,
        [
            F.approx_count_distinct(clean_value(n, df.schema[n].dataType)).alias(f"d{i}")
            for i, n in enumerate(kept)
        ],
    )
    return exact_distinct(df, [n for i, n in enumerate(kept) if sketch[f"d{i}"] <= SURELY_MANY])


def detect_target(df: DataFrame, analysis_type: str = "auto", exclude: Sequence[str] = ()) -> str | None:
    """The outcome column: typed names, generic names, fallbacks, last few-valued, last."""
    candidates = [c for c in df.columns if c not in set(exclude)]
    by_name = {c.lower(): c for c in candidates}
    wanted = [
        *TARGET_NAMES_BY_TYPE.get(analysis_type.lower(), []),
        *GENERIC_TARGET_NAMES,
        *FALLBACK_TARGET_NAMES,
    ]
    for name in wanted:
        if name in by_name:
            return by_name[name]
    counts = few_valued(df, candidates)
    small = [c for c in candidates if 2 <= counts.get(c, 0) <= 10]
    if small:
        return small[-1]
    return candidates[-1] if candidates else None


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, n, share of the non-null values), whole, unordered."""
    counts = long_values(df, names, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("_all")).alias("share")
    )


def top_values(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_counts(df, names)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
    )


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, smallest on ties; absent when all null."""
    if not names:
        return {}
    counts = long_values(df, names, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}


def problem_type(numeric: bool, distinct: int) -> str:
    return "regression" if numeric and distinct > 10 else "classification"


def target_info(df: DataFrame, target: str) -> DataFrame:
    """The five most frequent target values with the target's type facts on each row."""
    numeric = is_numeric(df.schema[target].dataType) or isinstance(df.schema[target].dataType, T.BooleanType)
    counts = df.filter(clean_value(target, df.schema[target].dataType).isNotNull()).groupBy(
        col(target).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    unique = counts.agg(F.count(F.lit(1)).alias("unique_count")).scalar()
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(5).withColumn("unique_count", unique)
    regression = F.lit(numeric) & (F.col("unique_count") > 10)
    return top.select(
        F.lit(target).alias("target"),
        F.col("value").cast("string").alias("value"),
        "n",
        "unique_count",
        F.lit(numeric).alias("is_numeric"),
        F.when(regression, "regression").otherwise("classification").alias("problem_type"),
    )


def _skewness(value: Column, n: Column) -> Column:
    """Sample skewness: the population figure with the small-sample factor; 0 when undefined."""
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    figure = F.nanvl(F.skewness(value), F.lit(None).cast("double"))
    return F.when(n > 2, F.coalesce(figure * factor, F.lit(0.0))).otherwise(0.0)


def numeric_stats(df: DataFrame, names: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """mean, median, std, min, max, skewness, nulls per numeric column with values."""
    names = list(names) if names is not None else numeric_columns(df)
    cells = [as_double(df, n) for n in names]
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cells):
        n = F.count(c)
        aggs += [
            n.alias(f"_n{i}"),
            F.avg(c).alias(f"_mean{i}"),
            F.when(n > 1, F.stddev_samp(c)).otherwise(0.0).alias(f"_std{i}"),
            F.min(c).alias(f"_min{i}"),
            F.max(c).alias(f"_max{i}"),
            _skewness(c, n).alias(f"_skew{i}"),
        ]
    records = [
        (
            name,
            [
                F.col(f"_n{i}"),
                F.col("_rows") - F.col(f"_n{i}"),
                *[F.bround(F.col(f"_{p}{i}"), digits) for p in ("mean", "std", "min", "max", "skew")],
            ],
        )
        for i, name in enumerate(names)
    ]
    stats = long_rows(df.agg(*aggs), records, ["n", "nulls", "mean", "std", "min", "max", "skewness"])
    medians = exact_quantiles(df, names, {"median": 0.5}).select(
        "column", F.bround("median", digits).alias("median")
    )
    return stats.join(F.broadcast(medians), "column").select(
        "column", "mean", "median", "std", "min", "max", "skewness", "nulls"
    )


def describe_numeric(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    names = list(names) if names is not None else numeric_columns(df)
    aggs: list[Column] = []
    for i, n in enumerate(names):
        c = as_double(df, n)
        aggs += [F.avg(c).alias(f"_a{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    moments = long_rows(
        df.agg(*aggs), [(n, [F.col(f"_a{i}"), F.col(f"_s{i}")]) for i, n in enumerate(names)], ["mean", "std"]
    )
    spots = exact_quantiles(df, names, {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0})
    return spots.join(F.broadcast(moments), "column").select(
        "column", F.col("n").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def column_facts(df: DataFrame, max_columns: int | None = None, digits: int = 2) -> DataFrame:
    """One evidence line per column: ranges for numbers with over 12 values, else top-6 shares."""
    names = [f.name for f in df.schema.fields if not is_nested(f.dataType)][:max_columns]
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    small = few_valued(df, numeric)
    ranged = [n for n in numeric if small.get(n, SURELY_MANY) > 12]
    listed = [n for n in names if n not in set(ranged)]
    parts = []
    if ranged:
        facts = numeric_stats(df, ranged, digits)
        parts.append(
            facts.select(
                "column",
                F.format_string(
                    "mean %.2f; median %.2f; min %.2f; max %.2f", "mean", "median", "min", "max"
                ).alias("fact"),
            )
        )
    if listed:
        top = top_values(df, listed, 6).withColumn("all", F.round(F.col("n") / F.col("share")).cast("bigint"))
        entry = F.format_string("%s: %.1f%%", F.col("value"), F.col("share") * 100)
        lines = top.groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("position", entry.alias("text")))).alias("entries"),
            F.max("all").alias("all"),
        )
        parts.append(
            lines.select(
                "column",
                F.concat(
                    F.array_join(F.col("entries.text"), "; "),
                    F.lit(" (of "),
                    F.format_number(F.col("all"), 0),
                    F.lit(" rows)"),
                ).alias("fact"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fact_card(df: DataFrame, title: str, target: str | None = None) -> DataFrame:
    """Rows, columns, missing cells, and the target's mean or most frequent value."""
    cells = [clean_value(f.name, f.dataType) for f in df.schema.fields]
    missing = F.count_if(cells[0].isNull())
    for c in cells[1:]:
        missing = missing + F.count_if(c.isNull())
    aggs = [F.count(F.lit(1)).alias("rows"), missing.alias("missing")]
    numeric = bool(target) and is_numeric(df.schema[target].dataType)
    if numeric:
        aggs.append(F.avg(as_double(df, target)).alias("target_mean"))
    base = df.agg(*aggs)
    numbers = [
        F.concat(F.lit("Rows: "), F.format_number("rows", 0)),
        F.lit(f"Cols: {len(df.columns)}"),
        F.format_string("Missing: %d", "missing"),
    ]
    if numeric:
        numbers.append(F.format_string(f"Avg {target}: %.2f", "target_mean"))
    elif target:
        best = top_values(df, [target], 1).select(F.struct("value", "n").alias("best")).scalar()
        base = base.withColumn("_best", best)
        numbers.append(
            F.format_string(
                f"Mode {target}: %s (%.1f%%)", F.col("_best.value"), F.col("_best.n") / F.col("rows") * 100
            )
        )
    return base.select(
        F.lit(title).alias("title"),
        F.array_join(F.array(*numbers), "; ").alias("numbers"),
        F.concat(
            F.lit(f"{title} reflects a data profile with "),
            F.format_number("rows", 0),
            F.format_string(" rows and %d missing values across the dataset.", "missing"),
        ).alias("finding"),
    )


def integrity_index(df: DataFrame) -> DataFrame:
    """100 less missing cells and duplicates per hundred rows, with a label."""
    missing = missing_values(df).agg(F.sum("nulls").alias("nulls"))
    both = duplicate_rows(df).withColumn("nulls", missing.scalar())
    index = F.greatest(
        F.lit(0.0),
        100 - (F.col("nulls") + F.col("duplicates")) / F.greatest(F.col("row_count"), F.lit(1)) * 100,
    )
    return both.select("row_count", "nulls", "duplicates", index.alias("integrity")).withColumn(
        "label",
        F.when(F.col("integrity") >= 95, "High Integrity")
        .when(F.col("integrity") >= 80, "Good Integrity")
        .otherwise("Needs Review"),
    )


def inspect(df: DataFrame, analysis_type: str = "auto", target: str | None = None) -> dict[str, object]:
    """The inspection plan: small facts that later steps decide on, plus result tables."""
    dup = duplicate_summary(df)
    rows = dup["rows"]
    duplicates = dup["repeats"]
    if duplicates:
        duplicates = duplicate_rows(df).first()["duplicates"]
    missing = {r["column"]: r["nulls"] for r in missing_values(df).collect()}
    ids = id_column_names(df, rows)
    chosen = target if target in df.columns else detect_target(df, analysis_type, ids)
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numeric_target = bool(chosen) and kinds[chosen] == "numerical"
    unique = 0
    if chosen:
        unique = few_valued(df, [chosen]).get(chosen, SURELY_MANY + 1)
        if unique > SURELY_MANY:
            unique = exact_distinct(df, [chosen])[chosen]
    return {
        "rows": rows,
        "columns": len(df.columns),
        "kinds": kinds,
        "missing_total": sum(missing.values()),
        "missing": {c: n for c, n in missing.items() if n},
        "duplicates": duplicates,
        "id_columns": ids,
        "target": chosen,
        "target_unique": unique,
        "problem_type": problem_type(numeric_target, unique),
        "stats": numeric_stats(df) if numeric_columns(df) else None,
        "target_top": target_info(df, chosen) if chosen else None,
    }
