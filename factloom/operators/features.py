"""Derived columns of the churn scripts: ratios, flags, counts, maps, rule segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, col
from factloom.operators.order import column_quantiles

# Codes, bands and payment names.
CONTRACT_RISK = {"Month-to-month": 3, "One year": 2, "Two year": 1}
AUTOMATIC_PAYMENTS = ("Bank transfer (automatic)", "Credit card (automatic)")
NEW_CUSTOMER_MONTHS, MEDIUM_RISK_MONTHS = 12, 24
TIER_LIMITS, LEGACY_TIER_LIMITS = (0.35, 0.70), (0.3, 0.6)


def mapped(value: Column, table: Mapping[str, object]) -> Column:
    """Value to code; values outside the table become null."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[value]


def count_matching(columns: Sequence[Column], wanted: str = "Yes") -> Column:
    """How many of the columns hold the wanted value."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce((c == wanted).cast("int"), F.lit(0))
    return total


def above_median(df: DataFrame, name: str) -> Column:
    median = column_quantiles(df, [name], {"median": 0.5})[name]["median"]
    return F.coalesce((as_double(df, name) > F.lit(median)).cast("int"), F.lit(0))


def ratio_plus_one(amount: Column, periods: Column) -> Column:
    return amount / (periods + 1)


def churn_features(df: DataFrame, services: Sequence[str]) -> DataFrame:
    """The six engineered columns of a subscription table."""
    return df.withColumns(
        {
            "charges_per_tenure": ratio_plus_one(as_double(df, "TotalCharges"), col("tenure")),
            "is_new_customer": (col("tenure") < NEW_CUSTOMER_MONTHS).cast("int"),
            "service_count": count_matching([col(s) for s in services]),
            "is_high_value": above_median(df, "MonthlyCharges"),
            "contract_risk": mapped(col("Contract"), CONTRACT_RISK),
            "is_auto_pay": col("PaymentMethod").isin(*AUTOMATIC_PAYMENTS).cast("int"),
        }
    )


def rule_segment(short_term: Column, tenure: Column) -> Column:
    """High for short-term contracts under 12 months, Medium from 12 to 24, else Low."""
    return (
        F.when(short_term & (tenure < NEW_CUSTOMER_MONTHS), "High Risk")
        .when(short_term & tenure.between(NEW_CUSTOMER_MONTHS, MEDIUM_RISK_MONTHS), "Medium Risk")
        .otherwise("Low Risk")
    )


def risk_tier(probability: Column, limits: tuple[float, float] = TIER_LIMITS) -> Column:
    return F.when(probability < limits[0], "Low").when(probability < limits[1], "Medium").otherwise("High")


def legacy_risk_tier(probability: Column) -> Column:
    low, high = LEGACY_TIER_LIMITS
    return F.when(probability >= high, "High Risk").when(probability >= low, "Medium Risk").otherwise("Low Risk")


def align_features(df: DataFrame, features: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly the wanted columns in order; absent ones filled."""
    return df.select(*[col(f) if f in df.columns else F.lit(fill).alias(f) for f in features])


def one_hot(df: DataFrame, name: str, levels: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns per level in text order, the first left out."""
    ordered = sorted(levels)[1 if drop_first else 0 :]
    flags = {f"{name}_{v}": F.coalesce((col(name).cast("string") == v).cast("int"), F.lit(0)) for v in ordered}
    return df.withColumns(flags).drop(name)
