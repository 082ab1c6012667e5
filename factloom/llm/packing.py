"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted sequence are cut into pieces of that size; all pieces are
packed whole. Pieces go, longest first, into the open sequence with the least room that still holds
them. If none does, a new one is opened: for each permitted size the pieces still to come are tried
in it greedily, and the size with the least cost per token wins. At the end each sequence is cut down
to the smallest permitted size that holds its contents.

Pieces are dealt over shards of bounded size by a hash of document and piece, and every shard is
packed in one task. The only loss against one global packing is the last few sequences of a shard.

Defined cases: null and empty texts have no tokens and come back with piece 0 and no sequence; equal
ids are rows of their own, told apart by ``text_hash`` and, if their texts are the same, by ``copy``; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.lengths import encoded_lengths
from factloom.session import materialize

SIZES = (512, 1024, 2048, 4096, 8192)
# A sequence costs its tokens, its share of attention, which grows with the square, and a fixed part for being a row of a batch.
FIXED_COST = 16
ATTENTION = 1 / 65536
SHARD_PIECES = 2000


def best_fit(lengths: list[int], sizes: tuple[int, ...] = SIZES, fixed: int = FIXED_COST) -> tuple[list[int], list[int]]:
    """Sequence number of each piece, and the size of each sequence."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    values = sorted(set(lengths))
    counts = dict.fromkeys(values, 0)
    for n in lengths:
        counts[n] += 1
    room: list[tuple[int, int]] = []  # (free tokens, sequence), sorted
    filled, place = [], [0] * len(lengths)
    for i in order:
        n = lengths[i]
        counts[n] -= 1
        if not counts[n]:
            values.pop(bisect_left(values, n))
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            number = len(filled)
            filled.append(0)
            free = _least_cost(n, values, counts, sizes, fixed)
        place[i] = number
        filled[number] += n
        if free > n:
            insort(room, (free - n, number))
    return place, [sizes[bisect_left(sizes, n)] for n in filled]


def _least_cost(first: int, values: list[int], counts: dict[int, int], sizes: tuple[int, ...], fixed: int) -> int:
    best = None
    for size in sizes[bisect_left(sizes, first) :]:
        rest, used = size - first, {}
        at = bisect_right(values, rest)
        while rest and at:
            n = values[at - 1]
            take = min(rest // n, counts[n] - used.get(n, 0))
            if take:
                used[n] = used.get(n, 0) + take
                rest -= n * take
            at = min(at - 1, bisect_right(values, rest))
        rate = (size + size * size * ATTENTION + fixed) / (size - rest)
        if best is None or rate < best[0]:
            best = (rate, size)
    return best[1]


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, text_hash, copy, piece, first token, tokens, sequence, offset in it, and its size."""
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    # Rows are told apart by their text's hash, and rows that are the same by a number, whatever the layout of the files.
    rows = encoded_lengths(docs, path, digest=True).groupBy("doc_id", "text_hash", "n_tokens").agg(F.count(F.lit(1)).alias("_rows"))
    lengths = materialize(rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))).drop("_rows"), "lengths")
    count = F.greatest(F.ceil(F.col("n_tokens") / most), F.lit(1)).cast("int")
    cut = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = cut.withColumn("first", F.col("piece").cast("long") * most).withColumn("tokens", F.least(F.lit(most).cast("long"), F.col("n_tokens") - F.col("first")))
    total = lengths.agg(F.sum(count)).first()[0] or 0
    shards = max(1, -(-total // SHARD_PIECES))
    kind = dict(lengths.dtypes)["doc_id"]
    own = ("doc_id", "text_hash", "copy", "piece")
    dealt = cut.where("tokens > 0").select(*own, "first", "tokens", F.pmod(F.xxhash64(*own), F.lit(shards)).alias("shard"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("tokens", "descending"), *((c, "ascending") for c in own)])
        tokens = part.column("tokens").to_pylist()
        place, size = best_fit(tokens, sizes)
        offset, used = [], [0] * len(size)
        for n, number in zip(tokens, place):
            offset.append(used[number])
            used[number] += n
        number = np.array(place, dtype=np.int64) + (part.column("shard")[0].as_py() << 32)
        return pa.table({**{c: part.column(c) for c in (*own, "first", "tokens")}, "sequence": number, "offset": pa.array(offset, pa.int64()), "size": pa.array([size[k] for k in place], pa.int32())})

    packed = dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, text_hash long, copy long, piece int, first long, tokens long, sequence long, offset long, size int")
    none = cut.where("tokens <= 0").select(*own, "first", "tokens", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("int").alias("size"))
    return packed.unionByName(none)
