"""Near-duplicate documents by SimHash fingerprints that differ in few bits.

1. One pass over the texts gives each document's fingerprint: bit k is set if more than half of the
   XXH64 hashes of its word shingles, repeats included, have it set. Equal fingerprints are one
   class, represented by the smallest id; all that follows is done on classes.
2. Pigeonhole blocks: the 64 bits are cut into ``bits + 2`` blocks. Fingerprints that differ in at
   most ``bits`` bits agree in two blocks at least, so each class goes once into the bucket of every
   pair of blocks. Only buckets with two classes or more go on.
3. A bucket of more than ``MEMBERS`` classes has a head, the class of most documents. Members near
   the head are linked to it at once and are never compared with each other. The others are cut into
   parts that meet each other and parts of the near ones, a pair of parts in one group, so no group
   grows with the bucket, and a cluster around a head is sent once.
4. In a group the Hamming distances are verified on whole fingerprints. Of what is connected there a
   star is returned, not the pairs. Connected components over all stars give the classes of texts.

Defined cases: null and blank texts have the fingerprint zero and are linked like any other; a text
of fewer words than a shingle is one shingle; rows of one id with unlike texts are rows of their own
that share a component; rows with a null id have a fingerprint, link nothing and come back with a
null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.links import components
from factloom.llm.substring import whole_groups
from factloom.llm.words import Splitter, bounded, pieces
from factloom.session import materialize

SEED = 42
MEMBERS = 1024
# In groups of up to so many members all distances are taken together.
SMALL = 32


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(lower=True)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(splitter, part.column(1), shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def text_fingerprints(splitter: Splitter, texts: pa.Array, shingle: int) -> np.ndarray:
    words = splitter(texts)
    data, begin = words.spaced()
    counts = np.diff(words.first)
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    ends = np.cumsum(shingles)
    doc = np.repeat(np.arange(len(counts)), shingles)
    head = words.first[:-1][doc] + np.arange(len(doc)) - (ends - shingles)[doc]
    last = np.minimum(head + shingle, words.first[1:][doc])
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin[last] - 1).tolist())), np.uint64, len(doc))
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (ends - shingles)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > shingles[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def block_masks(bits: int) -> list[int]:
    """The masks of all pairs of blocks."""
    blocks = bits + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(one, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _stars(groups: DataFrame, bits: int) -> DataFrame:
    """Stars (a, b) over what is linked in each group (k, key, part); rows hold fp and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["k", "key", "part"], "fp"):
            change = np.ones(table.num_rows, dtype=bool)
            cells = [table.column(c).to_numpy() for c in ("k", "key", "part")]
            change[1:] = np.any([c[1:] != c[:-1] for c in cells], axis=0)
            a, b = group_stars(table.column("fp").to_numpy().view(np.uint64), table.column("id").to_numpy(), np.flatnonzero(change), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["k", "key", "part"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp", "id").mapInArrow(run, "a long, b long").distinct()


def group_stars(fps: np.ndarray, ids: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of every member to the smallest id it is connected with in its group."""
    n = len(fps)
    sizes = np.diff(np.append(first, n))
    group = np.repeat(np.arange(len(first)), sizes)
    label = np.arange(n)
    small = sizes[group] <= SMALL
    one, two = [], []
    for lag in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        near = (group[lag:] == group[:-lag]) & small[lag:] & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= bits)
        at = np.flatnonzero(near)
        one.append(at)
        two.append(at + lag)
    if one:
        one, two = np.concatenate(one), np.concatenate(two)
        while len(one):  # the smallest place spreads along the links
            before = label.copy()
            low = np.minimum(label[one], label[two])
            np.minimum.at(label, one, low)
            np.minimum.at(label, two, low)
            label = label[label]
            if (label == before).all():
                break
    for g in np.flatnonzero(sizes > SMALL):
        left = np.arange(first[g], first[g] + sizes[g])
        while len(left):
            seed, left = left[0], left[1:]
            front = [seed]
            while front and len(left):
                near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= bits
                label[left[near]] = seed
                front.extend(left[near].tolist())
                left = left[~near]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    out = ids != least[label]
    return ids[out], least[label][out]


def _head_links(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of large buckets the links to their heads, and the groups of parts in which the others are still to be compared."""
    near = distance("fp", "head_fp") <= bits
    marked = materialize(rows.withColumn("near", near), "large-buckets")
    links = marked.where("near AND id != head_id").select(F.col("id").alias("a"), F.col("head_id").alias("b"))
    parts = marked.groupBy("k", "key").agg(F.count_if("near").alias("_near"), F.count_if(~F.col("near")).alias("_far"))
    parts = parts.where("_far > 0").select("k", "key", *[F.ceil(F.col(c) / (MEMBERS // 2)).cast("int").alias(c) for c in ("_near", "_far")])
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("near"), F.col("_near")).otherwise(F.col("_far"))).cast("int")
    spread = marked.join(parts, ["k", "key"]).withColumn("_own", own)
    # Far parts are numbered from 0, near ones follow; a group is a pair of parts with a far one in it.
    mine = F.when(F.col("near"), F.col("_own") + F.col("_far")).otherwise(F.col("_own"))
    others = F.when(F.col("near"), F.expr("sequence(0, _far - 1)")).otherwise(F.expr("sequence(0, _far + _near - 1)"))
    spread = spread.withColumn("_mine", mine).withColumn("_other", F.explode(others))
    part = F.least("_mine", "_other").cast("long") * (1 << 31) + F.greatest("_mine", "_other")
    return links, spread.select("k", "key", part.alias("part"), "fp", "id")


def similar_fingerprints(found: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, component) of every fingerprint in ``found`` (doc_id, fp) that some id has."""
    classes = materialize(found.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("docs")), "fingerprints")
    keys = [F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(block_masks(bits))]
    rows = classes.select("fp", "id", "docs", F.explode(F.array(*keys)).alias("_at")).select("_at.k", "_at.key", "fp", "id", "docs")
    buckets = materialize(
        rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("docs", "fp", "id")).alias("head")).where("members > 1")
        .select("k", "key", "members", F.col("head.fp").alias("head_fp"), F.col("head.id").alias("head_id")),
        "buckets",
    )
    shared = materialize(rows.join(buckets, ["k", "key"]).drop("docs"), "bucket-members")
    small = shared.where(F.col("members") <= MEMBERS).select("k", "key", F.lit(0).cast("long").alias("part"), "fp", "id")
    heads, groups = _head_links(shared.where(F.col("members") > MEMBERS).drop("members"), bits)
    linked = components(materialize(_stars(small.unionByName(groups), bits).unionByName(heads), "stars"))
    return classes.join(linked, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))


def near_by_simhash(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hexadecimal digits, component_id and kept."""
    found = materialize(fingerprints(bounded(docs), shingle), "simhash")
    joined = found.join(similar_fingerprints(found, bits), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
