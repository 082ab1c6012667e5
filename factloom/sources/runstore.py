"""Stored analysis runs: five append-only tables, tombstones and commits, keyed by run_id.

A write that may be repeated stages its rows under an attempt and names the attempt in ``commits`` as its last
step. Readers take rows of no attempt, and of the first attempt that finished each part of a run, so a repeated
write adds nothing and one that died halfway is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHAPES = {
    "runs": "user_id string, filename string, created_at timestamp, target string, problem_type string, model_card string, run_id string",
    "charts": "item_id bigint, title string, fact_card string, run_id string",
    "insights": "item_id bigint, text string, source string, run_id string",
    "chat_messages": "item_id bigint, role string, content string, created_at timestamp, run_id string",
    "predictions": "item_id bigint, inputs string, output string, created_at timestamp, run_id string",
    "tombstones": "deleted_at timestamp, run_id string",
    "commits": "part string, attempt string, committed_at timestamp, run_id string",
}
CHILDREN = ("charts", "insights", "chat_messages", "predictions")
SHARDS = 256


def shard_of(run_id):
    return F.pmod(F.xxhash64(run_id), F.lit(SHARDS)).cast("int")


def owned(caller: str | None):
    """Visible when there is no caller, the run has no owner, or they are equal."""
    if caller is None:
        return F.lit(True)
    return F.col("user_id").isNull() | (F.col("user_id") == F.lit(str(caller)))


def visible_runs(runs: DataFrame, tombstones: DataFrame, caller: str | None = None, strict: bool = False) -> DataFrame:
    """Runs that are not deleted; ``strict`` demands an equal owner, as listing does."""
    rule = (F.col("user_id") == F.lit(str(caller))) if strict and caller is not None else owned(caller)
    return runs.filter(rule).join(tombstones.select("run_id"), "run_id", "left_anti")


def run_document(runs: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """(run_id, section, item_id, payload): the run and all its parts as rows, in a stable order.

    The document stays in rows, so a run with very many messages is never
    gathered into one cell.
    """
    head = runs.select(
        "run_id", F.lit("run").alias("section"), F.lit(0).cast("bigint").alias("item_id"),
        F.to_json(F.struct(*[c for c in runs.columns if c != "run_id"])).alias("payload"),
    )
    parts = [head]
    for name, child in children.items():
        cells = F.to_json(F.struct(*[c for c in child.columns if c not in ("run_id", "item_id")]))
        kept = child.join(runs.select("run_id"), "run_id", "left_semi")
        parts.append(kept.select("run_id", F.lit(name).alias("section"), "item_id", cells.alias("payload")))
    return reduce(DataFrame.unionByName, parts)


def run_overview(runs: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Runs with the number of parts of each kind; runs without parts stay."""
    out = runs
    for name, child in children.items():
        counts = child.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = out.join(counts, "run_id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out


def latest_per_run(child: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    newest = Window.partitionBy("run_id").orderBy(*[F.desc(c) for c in order])
    return child.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= k)


def _names(shape: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in shape.split(",")]


def finished(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of no attempt, and those of the first attempt that finished each part of a run."""
    first = commits.groupBy("run_id", "part").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    staged = rows.where("attempt IS NOT NULL").join(first.drop("part"), ["run_id", "attempt"], "left_semi")
    return rows.where("attempt IS NULL").unionByName(staged).drop("attempt")


class RunStore:
    """The tables of a store folder. Children are written before the run row makes them visible."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _stored(self, name: str) -> DataFrame:
        """All stored rows with their attempt and shard."""
        shape = SHAPES[name] + ("" if name == "commits" else ", attempt string") + ", shard int"
        try:
            return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":  # only a table that was never written is empty
                raise
            return self.spark.createDataFrame([], shape)

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        """The rows readers may see; with ``run_id`` only that run's folders are read."""
        rows, commits = self._stored(name), self._stored("commits")
        if run_id is not None:
            own = (F.col("shard") == shard_of(F.lit(run_id))) & (F.col("run_id") == run_id)
            rows, commits = rows.filter(own), commits.filter(own)
        rows = rows.drop("shard")
        return rows if name == "commits" else finished(rows, commits)

    def append(self, name: str, rows: DataFrame, attempt: str | None = None) -> None:
        """Rows go to folders by a hash of the run, so their number does not grow with the runs.

        Rebalancing joins small writes and splits the folder of a run with very many rows. Rows of an
        attempt stay unseen until ``finish`` names it.
        """
        extra = [] if name == "commits" else [F.lit(attempt).cast("string").alias("attempt")]
        placed = rows.select(*_names(SHAPES[name]), *extra, shard_of(F.col("run_id")).alias("shard"))
        spread = placed.hint("rebalance", F.col("shard"))
        spread.write.mode("append").partitionBy("shard").parquet(f"{self.path}/{name}")

    def of_run(self, name: str, run_id: str) -> DataFrame:
        """One run's rows; only its folder is read."""
        return self.table(name, run_id)

    def _open(self, part: str, rows: DataFrame) -> DataFrame:
        """Rows of runs that do not have this part yet."""
        done = self._stored("commits").where(F.col("part") == part).select("run_id")
        return rows.join(done, "run_id", "left_anti")

    def stage(self, part: str, attempt: str, **tables: DataFrame) -> None:
        """Write tables with a run_id under an attempt; runs that have the part already are left out."""
        for name, rows in tables.items():
            self.append(name, self._open(part, rows), attempt)

    def finish(self, part: str, attempt: str, runs: DataFrame) -> None:
        """Show what the attempt staged: one row for each of ``runs`` (run_id), so a run has all of it or nothing."""
        marks = self._open(part, runs.select("run_id").distinct())
        self.append("commits", marks.select("run_id", F.lit(part).alias("part"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at")))

    def commit(self, part: str, **tables: DataFrame) -> None:
        """Stage tables as one part of all their runs and finish. May be repeated, also by several writers at once."""
        attempt = uuid.uuid4().hex
        self.stage(part, attempt, **tables)
        self.finish(part, attempt, reduce(DataFrame.unionByName, [t.select("run_id") for t in tables.values()]))

    def save(
        self,
        run_id: str,
        filename: str,
        target: str | None = None,
        problem_type: str | None = None,
        model_card: Mapping | None = None,
        user_id: str | None = None,
        **children: DataFrame,
    ) -> str:
        """The run and the parts given as tables, all or nothing; saving a run again adds nothing."""
        row = [(user_id, filename, target, problem_type, json.dumps(model_card or {}, default=str), run_id)]
        shape = "user_id string, filename string, target string, problem_type string, model_card string, run_id string"
        head = self.spark.createDataFrame(row, shape).withColumn("created_at", F.current_timestamp())
        parts = {n: children[n].withColumn("run_id", F.lit(run_id)) for n in CHILDREN if children.get(n) is not None}
        attempt = uuid.uuid4().hex
        self.stage("run", attempt, **parts, runs=head)
        self.finish("run", attempt, head)
        return run_id

    def add_predictions(
        self, run_id: str, scored: DataFrame, inputs: Sequence[str], outputs: Sequence[str], batch: str | None = None
    ) -> None:
        """Batch predictions as records: inputs and outputs as JSON. A batch that has a name is added once."""
        rows = scored.select(
            F.xxhash64(*inputs).alias("item_id"),
            F.to_json(F.struct(*inputs)).alias("inputs"),
            F.to_json(F.struct(*outputs)).alias("output"),
            F.current_timestamp().alias("created_at"),
            F.lit(run_id).alias("run_id"),
        )
        if batch is None:
            self.append("predictions", rows)
            return
        attempt, part = uuid.uuid4().hex, f"predictions {batch}"
        self.stage(part, attempt, predictions=rows)
        self.finish(part, attempt, self.spark.createDataFrame([(run_id,)], "run_id string"))

    def list(self, caller: str | None = None) -> DataFrame:
        runs = visible_runs(self.table("runs"), self.table("tombstones"), caller, strict=True)
        return runs.orderBy(F.desc("created_at"), "run_id")

    def get(self, run_id: str, caller: str | None = None) -> dict[str, DataFrame] | None:
        """The run and its parts as tables pruned to the run; None when absent, deleted or not owned."""
        runs = visible_runs(self.of_run("runs", run_id), self.of_run("tombstones", run_id), caller)
        if not runs.limit(1).count():
            return None
        return {"runs": runs, **{n: self.of_run(n, run_id) for n in CHILDREN}}

    def document(self, run_id: str, caller: str | None = None) -> DataFrame | None:
        found = self.get(run_id, caller)
        return run_document(found["runs"], {n: found[n] for n in CHILDREN}) if found else None

    def delete(self, run_id: str, caller: str | None = None) -> bool:
        """Hide a run and its parts; ``compact`` removes the rows."""
        if self.get(run_id, caller) is None:
            return False
        mark = self.spark.createDataFrame([(run_id,)], "run_id string").withColumn("deleted_at", F.current_timestamp())
        self.append("tombstones", mark)
        return True

    def compact(self, target: str) -> RunStore:
        """A copy of the store without deleted runs and unfinished attempts; it still knows the parts it has."""
        copy = RunStore(self.spark, target)
        gone = self.table("tombstones").select("run_id")
        for name in (*CHILDREN, "runs", "commits"):
            kept = self.table(name).join(gone, "run_id", "left_anti")
            if kept.limit(1).count():
                copy.append(name, kept)
        return copy
