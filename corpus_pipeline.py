"""A corpus pipeline: language, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.language import UNKNOWN, identify, train
from factloom.llm.neardup import near_duplicates
from factloom.llm.packing import pack
from factloom.llm.secrets import redact
from factloom.llm.substring import without_repeats
from factloom.session import materialize

# A document goes if its score covers less than this share of the way from an even guess to certainty.
LEAST_CERTAINTY = 1 / 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those for which no language stands out; without any labelled document only the former."""
    net = train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guess = 1 / len(net.languages)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= guess + (1 - guess) * LEAST_CERTAINTY - 1e-9)
    return identify(docs, net).where(kept).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows with one id and the same text one stays.

    Rows of one id with unlike texts stay together or go together; rows without an id all stay.
    """
    gone = near_duplicates(docs, shingle=5, percent=80).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").withColumn("_own", F.xxhash64("text"))
    return left.dropDuplicates(["doc_id", "_own"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id also has are cut out."""
    return _counted(without_repeats(docs, size=50))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequence, offset and size."""
    return pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    count = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return docs.select(*[count.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("secrets", secrets),
    ("packing", packing),
]
# Networks, trees and best fit can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
