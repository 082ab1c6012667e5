"""Registered queries: a name, the inventory rows it covers, the Spark callable, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"Query '{name}' is registered twice.")
        REGISTRY[name] = Query(name, covers, run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(name: str, digits: int = 4) -> Column:
    return F.round(F.col(name), digits).alias(name)


def rounded(df: DataFrame, digits: int = 4, only: tuple[str, ...] | None = None) -> DataFrame:
    """Doubles rounded for comparison across engines; other columns as they are."""
    names = only or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(F.col(n), digits) for n in names if n in df.columns})
