"""Input contract, batch validation, and prediction with tier, confidence and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, clean_value, col, is_numeric, long_rows, long_values, to_number
from factloom.modeling.scoring import FittedModel, score_table
from factloom.operators.features import risk_tier

NAMED_CATEGORIES = 25
CHURN_WORDS = ("churn", "attrition")


def schema_contract(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row per field: (position, field, kind, min, max); categories are in ``contract_categories``."""
    names = list(features or df.columns)
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    aggs = []
    for i, n in enumerate(names):
        if n in numeric:
            aggs += [F.min(as_double(df, n)).alias(f"a{i}"), F.max(as_double(df, n)).alias(f"b{i}")]
        else:
            aggs += [F.min(F.lit(None).cast("double")).alias(f"a{i}"), F.min(F.lit(None).cast("double")).alias(f"b{i}")]
    records = [
        (
            n,
            [
                F.lit(i),
                F.lit("numeric" if n in numeric else "categorical"),
                F.lit(df.schema[n].dataType.simpleString()),
                F.col(f"a{i}"),
                F.col(f"b{i}"),
            ],
        )
        for i, n in enumerate(names)
    ]
    return long_rows(df.agg(*aggs), records, ["position", "kind", "dtype", "min", "max"], key="field")


def contract_categories(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(field, category): every distinct value of the categorical fields."""
    names = [n for n in (features or df.columns) if not is_numeric(df.schema[n].dataType)]
    return long_values(df, names, "string").select(F.col("column").alias("field"), F.col("value").alias("category")).distinct()


def _blank(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    value = clean_value(name, df.schema[name].dataType)
    return value.isNull() | (value.cast("string") == "")


def validate_rows(df: DataFrame, contract: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``violations`` (array of field, rule, message) and ``violation``, the first one.

    Missing fields are reported together and stop the other checks of a row,
    the rest follow in contract order. Categories are joined, whatever their
    number; a message names the first 25 in text order.
    """
    fields = sorted(contract.collect(), key=lambda r: r["position"])
    place = F.row_number().over(Window.partitionBy("field").orderBy("category"))
    named: dict[str, list[str]] = {}
    for r in categories.withColumn("_rn", place).filter(F.col("_rn") <= NAMED_CATEGORIES).collect():
        named.setdefault(r["field"], []).append(r["category"])
    joined = df
    for i, name in enumerate(sorted(named)):
        if name in df.columns:
            known = categories.filter(F.col("field") == name).select(
                F.col("category").alias(f"_k{i}"), F.lit(True).alias(f"_known_{name}")
            )
            joined = joined.join(known, col(name).cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")

    def issue(field: str, rule: str, message: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), message.alias("message"))

    missing = F.array_compact(F.array(*[F.when(_blank(df, f["field"]), F.lit(f["field"])) for f in fields]))
    checks: list[Column] = []
    for f in fields:
        name = f["field"]
        if name not in df.columns:
            continue
        text = col(name).cast("string")
        if f["kind"] == "categorical":
            if name not in named:
                continue
            hint = f" Allowed categories: {', '.join(sorted(named[name]))}"
            message = F.concat(F.lit("Unknown category '"), text, F.lit(f"' for field '{name}'.{hint}"))
            checks.append(F.when(col(f"_known_{name}").isNull() & text.isNotNull(), issue(name, "unknown_category", message)))
            continue
        number = as_double(df, name) if is_numeric(df.schema[name].dataType) else to_number(col(name))
        bad = F.concat(F.lit("Invalid numeric value '"), text, F.lit(f"' for field '{name}'."))
        found = F.when(number.isNull(), issue(name, "not_numeric", bad))
        for rule, edge, outside, word in (
            ("below_min", f["min"], number < F.lit(f["min"]), "Minimum"),
            ("above_max", f["max"], number > F.lit(f["max"]), "Maximum"),
        ):
            if edge is not None:
                message = F.concat(
                    F.lit("Value "), number.cast("string"),
                    F.lit(f" for field '{name}' is out of range. {word} allowed value is {edge}."),
                )
                found = found.when(outside, issue(name, rule, message))
        checks.append(found)
    none = F.array().cast("array<struct<field:string,rule:string,message:string>>")
    gone = F.transform(
        missing,
        lambda m: F.struct(
            m.alias("field"),
            F.lit("missing").alias("rule"),
            F.concat(F.lit("Missing required field(s): "), F.array_join(missing, ", ")).alias("message"),
        ),
    )
    others = F.array_compact(F.array(*checks)) if checks else none
    issues = F.when(F.size(missing) > 0, gone).otherwise(others)
    return joined.withColumn("violations", issues).select(
        *[col(c) for c in df.columns], "violations", F.try_element_at("violations", F.lit(1))["message"].alias("violation")
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rows to quarantine with their reasons)."""
    ok = F.size("violations") == 0
    return validated.filter(ok).drop("violations", "violation"), validated.filter(~ok)


def confidence_text(probability: Column) -> Column:
    sure = F.when(probability >= 0.5, probability).otherwise(1 - probability)
    return F.format_string("%.1f%%", F.abs(sure) * 100)


def advice(target: str, tier: Column, confidence: Column, decision: Column) -> Column:
    """One line per row: retention wording for churn-like targets, else a plain statement."""
    if any(w in target.lower() for w in CHURN_WORDS):
        return (
            F.when(tier == "High", F.concat(F.lit("High churn risk ("), confidence, F.lit(" confidence): make a retention offer now.")))
            .when(tier == "Medium", F.concat(F.lit("Moderate churn risk ("), confidence, F.lit(" confidence): watch and queue a follow-up.")))
            .otherwise(F.concat(F.lit("Low churn risk ("), confidence, F.lit(" confidence): no action needed.")))
        )
    return F.concat(F.lit("Prediction: "), decision, F.lit(" with "), confidence, F.lit(" confidence. Risk level: "), tier, F.lit("."))


def with_decision(df: DataFrame, probability: str, threshold: float, classes: Sequence[str], target: str) -> DataFrame:
    """Decision, tier, confidence and advice from a positive-class probability."""
    p = col(probability)
    decision = F.when(p >= F.lit(threshold), F.lit(classes[1])).otherwise(F.lit(classes[0]))
    staged = df.withColumn("prediction", decision).withColumn("risk_tier", risk_tier(p)).withColumn("confidence", confidence_text(p))
    return staged.withColumn("recommendation", advice(target, F.col("risk_tier"), F.col("confidence"), F.col("prediction")))


def predict_batch(model: FittedModel, df: DataFrame) -> DataFrame:
    """Scores a table; works on a streaming table as well."""
    plan = model.plan
    scored = score_table(model, df, "_out")
    if plan.problem == "regression":
        value = F.round("_out", 2)
        return scored.withColumn("prediction", value).withColumn(
            "recommendation", F.concat(F.lit(f"Estimated outcome for {plan.target}: "), F.format_number("prediction", 2), F.lit("."))
        ).drop("_out")
    if len(plan.classes) == 2:
        out = scored.withColumn("probability", F.col("_out")[1]).drop("_out")
        return with_decision(out, "probability", model.threshold, plan.classes, plan.target)
    names = F.array(*[F.lit(c) for c in plan.classes])
    best = F.array_max("_out")
    out = scored.withColumn("probability", best).withColumn("prediction", names[(F.array_position("_out", best) - 1).cast("int")])
    out = out.withColumn("risk_tier", risk_tier(F.col("probability"))).withColumn("confidence", confidence_text(F.col("probability")))
    return out.withColumn("recommendation", advice(plan.target, F.col("risk_tier"), F.col("confidence"), F.col("prediction"))).drop("_out")
