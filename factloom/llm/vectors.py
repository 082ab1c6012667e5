"""Shared steps of the searches: valid rows, copies of the same vector, packed blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, nonzero: bool, component: str = "double") -> DataFrame:
    """(vec_id, vector) with components of this type: no null or non-finite component, ids not null, one row per id.

    Of several rows with one id the smallest vector is taken.
    """
    x = F.col("embedding").cast(f"array<{component}>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = F.col("vec_id").isNotNull() & x.isNotNull() & finite
    if nonzero:
        kept = kept & F.exists(x, lambda v: v != 0.0)
    found = rows.where(F.coalesce(kept, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
    return found.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def with_roles(vectors: DataFrame, is_query: Column, copies: int) -> DataFrame:
    """Rows that can appear in a result or ask for one.

    Of all rows with the same vector only the ``copies`` smallest ids can be among the first copies - 1
    of any ranking, since ties go to the smaller id and only the query's own row is left out. The hash
    before the vector lets the sort compare numbers.
    """
    place = F.row_number().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id"))
    candidates = vectors.withColumn("_place", place).where(F.col("_place") <= copies).select("vec_id", "vector", F.lit(True).alias("candidate"), F.lit(False).alias("query"))
    queries = vectors.where(is_query).select("vec_id", "vector", F.lit(False).alias("candidate"), F.lit(True).alias("query"))
    return candidates.unionByName(queries)


def matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dims).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(lengths), dims))
    for i, (a, n) in enumerate(zip(offsets[:-1], lengths)):
        out[i, :n] = values[a : a + n]
    return out


def width(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 0
