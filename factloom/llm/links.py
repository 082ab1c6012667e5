"""Connected components of a table of links, computed as Spark joins.

Every round points both ends of each link at the smallest end known to either (large star, then
small star) and is written to the shared folder, so a round survives the loss of executors. The
number of rounds grows with the logarithm of the longest chain of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them."""
    pairs = links if larger_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that both sides of the join are plain exchanges and the neighbours of a hub can be split over tasks.
    least = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = pairs.join(least, "a")
    if larger_only:  # neighbours below the node, and the node itself
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); the component is the smallest id that can be reached."""
    current = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    mark = _mark(current)
    for _ in range(rounds):
        current = materialize(_star(_star(current, False), True), "links")
        now = _mark(current)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("The links form chains too long for the allowed number of rounds.")
    leaves = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return leaves.unionByName(roots.join(leaves.select("id"), "id", "left_anti"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
    return row["n"], row["x"], row["s"]
