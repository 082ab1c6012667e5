"""Feature plan and the preprocessing stages; everything persists with the pipeline."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, clean_value, col, is_nested, is_numeric, is_temporal, quoted
from factloom.operators.order import column_quantiles
from factloom.operators.profile import few_valued, id_column_names, modes, value_counts
from factloom.session import materialize

# Guards, folds and the level limit of one-hot columns.
ID_SUFFIXES = ("id", "uuid", "guid", "key")
MIN_ROWS, MAX_CLASSES, MAX_FOLDS, MINORITY_LIMIT = 15, 10, 5, 0.20
SEED = 42
OTHER_LEVEL = "__OTHER__"
ROWS_PER_BUCKET = 100_000
# Rows that make a task of a fit worth while, and tasks for each core.
ROWS_PER_TASK, TASKS_PER_CORE = 5_000, 4


class ModelingError(ValueError):
    """The table cannot be modelled; the message says why."""


@dataclass
class FeaturePlan:
    target: str
    problem: str
    rows: int
    classes: list[str] = field(default_factory=list)
    class_counts: list[int] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    common: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    shares: dict[str, dict[str, float]] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.dates, *self.categorical]

    @property
    def feature_means(self) -> list[float]:
        """Training means of the model features: 0 for standardised numbers, shares for flags."""
        means = [0.0] * (len(self.numeric) + 3 * len(self.dates))
        for c in self.categorical:
            known = self.shares.get(c, {})
            means += [known.get(v, max(0.0, 1.0 - sum(known.values()))) for v in self.levels[c]]
        return means

    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        names += [f"{d}_{part}" for d in self.dates for part in ("day", "month", "weekday")]
        names += [f"{c}_{level}" for c in self.categorical for level in self.levels[c]]
        return names


def plan_features(df: DataFrame, target: str, max_levels: int | None = None) -> FeaturePlan:
    """Guards, problem type, usable features, fills and levels, from a few aggregates.

    A text column keeps all its levels, which are the names of the model's flags; with ``max_levels`` it
    keeps the most frequent ones and the others share one. Flags are sparse, one entry per row and column.
    """
    if not target or target not in df.columns:
        raise ModelingError(f"Target column '{target}' not present in dataframe.")
    data = df.filter(clean_value(target, df.schema[target].dataType).isNotNull())
    rows = data.count()
    if rows < MIN_ROWS:
        raise ModelingError(f"Insufficient sample size ({rows} rows) for supervised modeling.")
    few = few_valued(data, [target]).get(target)
    if few is not None and few < 2:
        raise ModelingError(
            f"Target column '{target}' has only 1 unique value. "
            "Modeling requires at least 2 distinct classes or variance."
        )
    is_class = few is not None and few <= MAX_CLASSES
    if not is_class and not is_numeric(df.schema[target].dataType):
        raise ModelingError(f"Target column '{target}' has more than {MAX_CLASSES} text values; use a numeric target.")
    plan = FeaturePlan(target, "classification" if is_class else "regression", rows)
    if is_class:
        counts = {r["value"]: r["n"] for r in value_counts(data, [target]).collect()}
        plan.classes = sorted(counts)
        plan.class_counts = [counts[c] for c in plan.classes]

    usable = [f for f in data.schema.fields if f.name != target and not is_nested(f.dataType)]
    ids = set(id_column_names(data.select(*[col(f.name) for f in usable]), rows, ID_SUFFIXES))
    for f in usable:
        if f.name in ids:
            continue
        if is_numeric(f.dataType):
            plan.numeric.append(f.name)
        elif is_temporal(f.dataType):
            plan.dates.append(f.name)
        else:
            plan.categorical.append(f.name)
    if not plan.features:
        raise ModelingError("No valid predictor features available for training.")

    dated = data.select("*", *_date_parts(plan))
    parts = [f"{d}_{p}" for d in plan.dates for p in ("day", "month", "weekday")]
    medians = column_quantiles(dated, [*plan.numeric, *parts], {"median": 0.5})
    plan.medians = {n: medians.get(n, {}).get("median") or 0.0 for n in [*plan.numeric, *parts]}
    plan.common = {c: v for c, v in modes(data, plan.categorical).items()}
    if plan.categorical:
        order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        top = value_counts(data, plan.categorical)
        if max_levels is not None:
            top = top.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_levels + 1)
        for r in top.orderBy("column", F.desc("n"), "value").collect():
            plan.levels.setdefault(r["column"], []).append(r["value"])
            plan.shares.setdefault(r["column"], {})[r["value"]] = r["share"]
        for c, found in plan.levels.items():
            if max_levels is not None and len(found) > max_levels:
                plan.shares[c].pop(found[-1])
                found = [*sorted(found[:max_levels]), OTHER_LEVEL]
            plan.levels[c] = found if OTHER_LEVEL in found else sorted(found)
        plan.categorical = [c for c in plan.categorical if c in plan.levels]
    return plan


def _date_parts(plan: FeaturePlan) -> list[Column]:
    out = []
    for d in plan.dates:
        day = F.to_date(col(d))
        out += [
            F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double").alias(f"{d}_day"),
            F.month(day).cast("double").alias(f"{d}_month"),
            F.weekday(day).cast("double").alias(f"{d}_weekday"),
        ]
    return out


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def prep_stages(plan: FeaturePlan, prefix: str = "") -> list:
    """Stages from raw columns to ``<prefix>features``; unknown levels become all zeros."""
    cells: list[str] = []
    numbers: list[str] = []
    for i, n in enumerate(plan.numeric):
        name = f"{prefix}_n{i}"
        cells.append(f"coalesce(nanvl(cast({quoted(n)} as double), null), {plan.medians[n]!r}D) as {name}")
        numbers.append(name)
    for i, d in enumerate(plan.dates):
        day = f"to_date({quoted(d)})"
        for part, expr in (
            ("day", f"datediff({day}, date'1970-01-01')"),
            ("month", f"month({day})"),
            ("weekday", f"weekday({day})"),
        ):
            name = f"{prefix}_d{i}_{part}"
            cells.append(f"coalesce(cast({expr} as double), {plan.medians[f'{d}_{part}']!r}D) as {name}")
            numbers.append(name)
    texts: list[str] = []
    for i, c in enumerate(plan.categorical):
        name = f"{prefix}_c{i}"
        value = f"coalesce(cast({quoted(c)} as string), {_sql_text(plan.common[c])})"
        if OTHER_LEVEL in plan.levels[c]:
            kept = ", ".join(_sql_text(v) for v in plan.levels[c] if v != OTHER_LEVEL)
            value = f"case when {value} in ({kept}) then {value} else '{OTHER_LEVEL}' end"
        cells.append(f"{value} as {name}")
        texts.append(name)
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")]
    parts: list[str] = []
    if numbers:
        stages += [
            VectorAssembler(inputCols=numbers, outputCol=f"{prefix}_numbers"),
            StandardScaler(inputCol=f"{prefix}_numbers", outputCol=f"{prefix}_scaled", withMean=True, withStd=True),
        ]
        parts.append(f"{prefix}_scaled")
    for i, c in enumerate(plan.categorical):
        # The slot kept for unknown levels is the last one, which the encoder drops.
        index, flags = f"{prefix}_i{i}", f"{prefix}_o{i}"
        labels = StringIndexerModel.from_labels(plan.levels[c], inputCol=texts[i], outputCol=index, handleInvalid="keep")
        stages += [labels, OneHotEncoder(inputCols=[index], outputCols=[flags], dropLast=True)]
        parts.append(flags)
    stages.append(VectorAssembler(inputCols=parts, outputCol=f"{prefix}features"))
    return stages


def prep_pipeline(plan: FeaturePlan, prefix: str = "") -> Pipeline:
    return Pipeline(stages=prep_stages(plan, prefix))


def label_column(df: DataFrame, plan: FeaturePlan) -> Column:
    """Class position in text order, or the number itself."""
    if plan.problem == "regression":
        return as_double(df, plan.target)
    text = col(plan.target).cast("string")
    out = F.when(text == plan.classes[0], 0.0)
    for i, c in enumerate(plan.classes[1:], 1):
        out = out.when(text == c, float(i))
    return out


def class_weights(plan: FeaturePlan) -> list[float]:
    """Rows over classes times class size: every class weighs the same."""
    total = sum(plan.class_counts)
    return [total / (len(plan.classes) * n) for n in plan.class_counts]


def weight_column(plan: FeaturePlan) -> Column:
    out = F.lit(1.0)
    if plan.problem == "classification":
        for i, w in enumerate(class_weights(plan)):
            out = F.when(F.col("_y") == float(i), w).otherwise(out)
    return out


def fold_count(plan: FeaturePlan) -> int:
    if plan.problem == "regression":
        return min(MAX_FOLDS, max(2, plan.rows // 3))
    folds = min(MAX_FOLDS, min(plan.class_counts))
    if folds < 2:
        raise ModelingError("At least two examples per class are required for stratified cross-validation.")
    return folds


def assign_folds(df: DataFrame, folds: int, rows: int, stratify: str | None, name: str = "_fold", seed: int = SEED) -> DataFrame:
    """Adds a fold number: the rank of a row's hashed ``_place`` within its class, modulo the folds.

    Classes differ by at most one row between folds.
    """
    ranked = hash_ranks(df, rows, stratify, seed)
    return ranked.withColumn(name, (F.col("_rank") % folds).cast("int")).drop("_rank")


def hash_ranks(df: DataFrame, rows: int, stratify: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``_rank``, from 0: the place of a row in the order of its hashed ``_place``, within its class if there is one.

    Hashes are even, so ranges of them cut a class into buckets of known size, and a row's rank is its
    rank in its bucket after the rows of the lower ones. The number of buckets spreads the work and
    does not change the ranks.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    by = [stratify] if stratify else []
    order = F.shiftrightunsigned(F.xxhash64("_place", F.lit(seed)), 1)
    marked = df.withColumn("_order", order).withColumn("_bucket", F.floor(F.col("_order") / F.lit(2.0**63) * buckets).cast("int"))
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", "_place")
    ranked = marked.withColumn("_rank", F.row_number().over(inside)).join(ahead, [*by, "_bucket"])
    return ranked.select(*[col(c) for c in df.columns], (F.col("_rank") - 1 + F.col("_ahead")).alias("_rank"))


def training_table(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Features with ``_y``, ``_w``, ``_place``, ``_fold`` and ``_test`` (a fifth of each class).

    The place of a row is written with it, so folds are the same in every job.
    """
    data = df.select(*[col(f) for f in plan.features], label_column(df, plan).alias("_y")).filter(
        F.col("_y").isNotNull()
    )
    data = materialize(data.withColumn("_place", F.monotonically_increasing_id()), "train")
    data = data.withColumn("_w", weight_column(plan))
    strata = "_y" if plan.problem == "classification" else None
    split = assign_folds(data, MAX_FOLDS, plan.rows, strata, "_fifth", SEED + 1)
    split = split.withColumn("_test", F.col("_fifth") == 0).drop("_fifth")
    split = assign_folds(split, fold_count(plan), plan.rows, strata)
    return materialize(spread(split, plan.rows), "train")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt by ``_place`` over the cores. A written file is read by one task, and the ranking leaves few of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(TASKS_PER_CORE * cores, rows // ROWS_PER_TASK)), "_place")
