"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Parts of a dealt table for each core, and the rows that make a part worth while.
DEALS_PER_CORE, ROWS_PER_DEAL = 4, 5_000


def build_session(app_name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, skew handling."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, since executors would not see a local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="factloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    Used where a result feeds several jobs: it cuts lineage, survives the loss
    of executors, and later jobs prune its columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt evenly over the cores, for tables that many passes read: the files and row groups of the input then do not decide how many cores work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(DEALS_PER_CORE * cores, rows // ROWS_PER_DEAL)))


def run_jobs(spark: SparkSession, work: Callable, items: Iterable, parallel: int) -> list:
    """Submit independent jobs from a few threads, in order of the items."""
    todo = list(items)
    if parallel <= 1 or len(todo) <= 1:
        return [work(item) for item in todo]
    with ThreadPool(min(parallel, len(todo))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), todo)

