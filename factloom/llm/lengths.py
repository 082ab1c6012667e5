"""Token counts of a corpus as an exact histogram of encoded lengths.

All documents are encoded and counted by length. Suffix sums over the distinct lengths then answer,
for a context limit equal to any length, how many documents are longer, how many tokens truncation
keeps and loses, and which quantile the limit is. The sums run in two steps, inside blocks of lengths
and over the blocks, so no task sees more than a block of the histogram or its block totals.

Defined cases: null and empty texts have length 0; texts of any length are encoded whole; repeated
rows count each; an empty table gives an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.encoding import shared_encoder, tokenizer_text
from factloom.llm.words import bounded, pieces
from factloom.session import materialize

BLOCK = 32


def encoded_lengths(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens) of every row; with ``digest`` also ``text_hash``."""
    definition = tokenizer_text(path)
    rows = bounded(docs).select("doc_id", "text", *([F.xxhash64("text").alias("text_hash")] if digest else []))
    shared = rows.sparkSession.sparkContext.broadcast(definition)  # a tokenizer file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                own = [c for k, c in enumerate(part.columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*own, pa.array(encoder.lengths(part.column(1)), pa.int64())], names=["doc_id", "text_hash", "n_tokens"] if digest else ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {'text_hash long, ' if digest else ''}n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of every length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def length_table(counts: DataFrame) -> DataFrame:
    """Per length L, taken as a context limit: documents of that length, longer ones, tokens of both, kept and cut tokens, quantile."""
    base = materialize(counts, "lengths").withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = base.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum"))
    above = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Block totals: one row for every BLOCK lengths up to the longest document.
    bases = blocks.select(
        "_block", F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_tokens_above")
    )
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = base.join(bases, "_block").select(
        "n_tokens", "n_docs", "_tokens",
        (F.col("_docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("_tokens_above") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).alias("tokens_longer"),
    )
    total = base.agg(F.sum("n_docs").alias("total_docs"), F.sum("_tokens").alias("total_tokens"))
    joined = sums.join(F.broadcast(total))  # one row
    return joined.select(
        "n_tokens", "n_docs", "docs_longer", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("kept_tokens"),
        (F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens")).alias("cut_tokens"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Total, kept and cut tokens for given context limits, whether or not a document has that length."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # The longest length not above the limit holds the suffix sums that the limit needs.
    below = table.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context_limit")).groupBy("context_limit").agg(
        F.max_by(F.struct("n_tokens", "docs_longer", "total_docs", "total_tokens", "cut_tokens"), "n_tokens").alias("r")
    )
    first = table.agg(F.max("total_docs").alias("all_docs"), F.max("total_tokens").alias("all_tokens"))
    joined = asked.join(below, "context_limit", "left").join(F.broadcast(first))
    longer = F.coalesce("r.docs_longer", "all_docs")
    cut = F.coalesce(F.col("r.cut_tokens") - F.col("r.docs_longer") * (F.col("context_limit") - F.col("r.n_tokens")), F.col("all_tokens") - F.col("all_docs") * F.col("context_limit"))
    return joined.select("context_limit", longer.alias("docs_longer"), F.col("all_tokens").alias("total_tokens"), (F.col("all_tokens") - cut).alias("kept_tokens"), cut.alias("cut_tokens"))


def quantile_lengths(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least the given share of all documents does not exceed."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return table.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
