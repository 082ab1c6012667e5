"""Business relevance score of a table from its column names and amounts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import as_double, is_temporal, numeric_columns

# Vocabulary, points and verdict limits of the gate.
BUSINESS_WORDS = (
    "customer", "cust", "client", "sales", "revenue", "price", "order",
    "product", "region", "discount", "profit", "churn", "subscription",
    "employee", "salary", "invoice", "cost", "quantity", "category",
    "payment", "contract", "lead", "deal", "transaction", "account",
    "billing", "user", "vendor", "spend", "margin", "tax", "fee",
    "tenure", "quota", "conversion", "retention", "attrition", "purchase",
)
TIME_WORDS = ("date", "time", "year", "month", "day", "timestamp")
OUTCOME_WORDS = ("target", "churn", "status", "converted", "default", "fraud", "outcome", "label")
GENERIC_NAME = re.compile(r"^(col|column|var|x|v|feat|feature)[_\-\d]*$", re.IGNORECASE)
POINTS_PER_WORD, MAX_WORD_POINTS = 15, 45
MONEY_POINTS, TIME_POINTS, OUTCOME_POINTS, GENERIC_FLOOR = 20, 20, 15, 40
BUSINESS_LIMIT, BORDERLINE_LIMIT = 50, 25


def _has(name: str, words: tuple[str, ...]) -> bool:
    return any(w in name.lower() for w in words)


def relevance(df: DataFrame, name: str) -> DataFrame:
    """One row: score, verdict, matched columns. Only the money signal reads data."""
    matched = [c for c in df.columns if _has(c.strip(), BUSINESS_WORDS)]
    numbers = numeric_columns(df)
    dated = any(is_temporal(f.dataType) or _has(f.name, TIME_WORDS) for f in df.schema.fields)
    fixed = min(MAX_WORD_POINTS, POINTS_PER_WORD * len(matched))
    fixed += TIME_POINTS if dated and numbers else 0
    fixed += OUTCOME_POINTS if any(_has(c, OUTCOME_WORDS) for c in df.columns) else 0
    generic = all(GENERIC_NAME.match(c.strip()) for c in df.columns)

    money = F.lit(False)
    for c in numbers:
        value = as_double(df, c)
        money = money | F.coalesce(
            (F.min(value) >= 0) & F.avg(value).between(5.0, 500_000.0) & (F.max(value) > 10.0),
            F.lit(False),
        )
    points = F.lit(fixed) + F.when(F.col("money_signal"), MONEY_POINTS).otherwise(0)
    if generic:
        points = F.greatest(points, F.lit(GENERIC_FLOOR))
    score = F.when(F.col("row_count") == 0, 0).otherwise(F.least(F.lit(100), points))
    return df.agg(F.count(F.lit(1)).alias("row_count"), money.alias("money_signal")).select(
        F.lit(name).alias("table_name"),
        score.cast("bigint").alias("score"),
        F.when(score >= BUSINESS_LIMIT, "business")
        .when(score >= BORDERLINE_LIMIT, "borderline")
        .otherwise("not_business")
        .alias("verdict"),
        "money_signal",
        F.lit(", ".join(matched)).alias("columns_found"),
    )


def relevance_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Score every table of a catalog in one plan."""
    return reduce(DataFrame.unionByName, [relevance(df, name) for name, df in tables.items()])
