"""Picking the table with the most rows from a catalog or a database."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for all tables in one plan."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def largest_of(tables: Mapping[str, DataFrame]) -> str:
    """The name of the longest table, the first by name among equals."""
    if not tables:
        raise ValueError("There are no tables.")
    best = table_sizes(tables).orderBy(F.desc("row_count"), "table_name").first()
    if not best["row_count"]:
        raise ValueError("All tables are empty.")
    return best["table_name"]


def largest_table(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The longest table of a catalog database."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    tables = {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in listed}
    return tables[largest_of(tables)]


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, parts: int = 64, **options: str
) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    base = {"url": url, **options}
    ends = (
        spark.read.format("jdbc").options(**base, query=f"select min({key}) as a, max({key}) as b from {table}").load().first()
    )
    split = {"partitionColumn": key, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**base, dbtable=table, **split).load()
