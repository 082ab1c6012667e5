"""Near-duplicate documents with b-bit MinHash, confirmed on full sets of word shingles.

1. One pass over the texts gives, per document, the size and a 128-bit fingerprint of its shingle
   set, the hashes of its bands of minima, and the low ``BITS`` bits of all minima, packed.
2. Documents with equal sets are one class, represented by the smallest id; all that follows is
   done on representatives. Only buckets (band, hash) with two members or more go on, and of
   buckets with the same members in several bands one.
3. A bucket is cut into blocks of bounded size, and a pair of blocks is one group, so no group grows
   with the bucket. In a group the packed bits are compared by counting, the agreement is corrected
   for chance collisions, and members that reach no partner are left out.
4. What the groups leave is joined to candidate components, each cut into pairs of blocks again, so
   that the full set of a member travels once in all but large components. A component for which the
   groups of step 3 would send fewer sets keeps those, cut in the same way by members and shingles.
5. In a group the links are confirmed exactly on full sets. A group returns a spanning star of each
   set of connected members, not its pairs; connected components over all stars give the classes.

Bands: a pair at the threshold 0.8 shares none of 32 bands of 4 minima with probability (1 - 0.8^4)^32
= 5e-8, and falls under the bound on the estimate with 4.5 standard errors. Sets are compared as
64-bit hashes of shingles.

Defined cases: null or blank text has an empty set and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows of one id are rows of their own, share a component and are linked
by what any of their texts is linked with; rows with a
null id form no links and come back with a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.links import components
from factloom.llm.words import Powers, Splitter, bounded, mixed, pieces, windows
from factloom.operators.order import broadcast_if_small
from factloom.session import materialize

MINIMA = 128
BAND = 4
BITS = 4
STANDARD_ERRORS = 4.5
# A block of a bucket holds about so many members while packed bits are compared,
BITS_MEMBERS = 4096
# and so many members and shingles while full sets are.
SET_MEMBERS = 256
SET_SHINGLES = 500_000
# Up to so many ids of candidates are sent to all tasks that read the texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
ROLL = 0xC2B2AE3D27D4EB4F
PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary"


def shingle_sets(splitter: Splitter, rolls: tuple[Powers, Powers], texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and where each text's begin."""
    words = splitter(texts)
    n = len(words.first) - 1
    counts = np.diff(words.first)
    own = words.hashes
    hashes, _, doc = windows(own, words.first, size, rolls)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([_sequence(own[words.first[i] : words.first[i + 1]]) for i in short], dtype=np.uint64)
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    # Sorted by hash first, then stably by text: the second sort sees mostly small numbers.
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(n + 1))


def _sequence(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * ROLL + h) & 0xFFFFFFFFFFFFFFFF
    return total


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """Size, fingerprint, band hashes and packed low bits of every document's shingle set."""
    rng = np.random.default_rng(11)
    multipliers = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
    salts = rng.integers(0, 1 << 63, MINIMA // BAND, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, rolls = Splitter(lower=True), (Powers(ROLL), Powers(pow(ROLL, -1, 1 << 64)))
        for batch in batches:
            for part in pieces(batch):
                sets, first = shingle_sets(splitter, rolls, part.column(1), shingle)
                n = part.num_rows
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                at = first[full]
                minima = np.zeros((MINIMA, len(full)), dtype=np.uint32)
                set_a, set_b = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                if len(full):
                    base = (sets >> np.uint64(32)).astype(np.uint32)
                    for k in range(MINIMA):
                        minima[k] = np.minimum.reduceat(base * multipliers[k], at)
                    set_a[full] = np.add.reduceat(mixed(sets), at)
                    set_b[full] = np.add.reduceat(mixed(sets ^ np.uint64(ROLL)), at)
                bands = np.zeros((len(full), MINIMA // BAND), dtype=np.uint64)
                for j in range(MINIMA // BAND):
                    h = np.full(len(full), salts[j])
                    for k in range(BAND):
                        h = mixed(h ^ minima[j * BAND + k])
                    bands[:, j] = h
                low = (minima.T & np.uint32((1 << BITS) - 1)).astype(np.uint8)
                packed = (low[:, 0::2] | (low[:, 1::2] << 4)) if len(full) else np.empty((0, MINIMA // 2), np.uint8)
                sizes = np.zeros(n, dtype=np.int64)
                sizes[full] = 1
                band_ends = np.concatenate([[0], np.cumsum(sizes * (MINIMA // BAND))]).astype(np.int32)
                bit_ends = np.concatenate([[0], np.cumsum(sizes * packed.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts.astype(np.int64)),
                        pa.array(set_a.view(np.int64)),
                        pa.array(set_b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(band_ends), pa.array(bands.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bit_ends), pa.py_buffer(np.ascontiguousarray(packed))]),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PROFILE)


def _blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, id): every pair of members of a bucket meets in at least one group of two blocks."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = members.join(blocks.select("bucket", "blocks"), "bucket").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return spread.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "id"
    ).distinct()


def _pruned(groups: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """The members of each group that reach a partner by the estimate, under a new group number for each connected part."""
    chance = 2.0**-BITS
    expected = threshold + (1 - threshold) * chance
    error = (expected * (1 - expected) / MINIMA) ** 0.5
    least = MINIMA * (expected - STANDARD_ERRORS * error)

    def run(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        n = len(ids)
        rows = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(n, -1)
        label = np.full(n, -1)
        left = np.arange(n)
        group = int(part.column("group")[0].as_py())
        while len(left):
            seed, left = left[0], left[1:]
            label[seed] = seed
            front = [seed]
            while front and len(left):
                near = agreements(rows[front.pop()], rows[left]) >= least
                found = left[near]
                label[found] = seed
                front.extend(found.tolist())
                left = left[~near]
        sizes = np.bincount(label, minlength=n)
        kept = sizes[label] > 1
        number = mixed(np.uint64(group & 0xFFFFFFFFFFFFFFFF) ^ mixed(ids[label].astype(np.uint64)))
        return pa.table({"group": number.view(np.int64)[kept], "id": ids[kept], "head": ids[label][kept]})

    return groups.join(bits, "id").groupBy("group").applyInArrow(run, "group long, id long, head long")


def agreements(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of the packed minima agree, by counting zero nibbles of the difference."""
    x = many ^ one
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    x &= np.uint64(0x1111111111111111)
    return MINIMA - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _candidate_groups(pruned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, id): blocks of candidate components, or blocks of the groups they came from where those are fewer rows."""
    component = components(pruned.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    members = materialize(component.join(sizes, "id").select(F.col("component").alias("bucket"), "id", "n_shingles"), "candidate-components")
    own = _distinct_groups(pruned.select("group", "id")).join(members, "id")
    cut = F.greatest(F.ceil(F.col("members") / SET_MEMBERS), F.ceil(F.col("shingles") / SET_SHINGLES)).cast("int")
    bounds = [F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")]
    blocks = members.groupBy("bucket").agg(*bounds).withColumn("blocks", cut)
    # A group lies in one component.
    parts = own.groupBy("bucket", "group").agg(*bounds).withColumn("blocks", cut)
    sent = parts.groupBy("bucket").agg(F.sum(F.col("members") * F.col("blocks")).alias("sent"))
    large = blocks.join(sent, "bucket").where(F.col("members") * F.col("blocks") > F.col("sent")).select("bucket")
    kept = own.join(large, "bucket", "left_semi").select(F.col("group").alias("bucket"), "id")
    return _blocks(members.join(large, "bucket", "left_anti"), blocks).unionByName(_blocks(kept, parts.select(F.col("group").alias("bucket"), "blocks")))


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """One of all groups that have the same members."""
    seen = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("m"))
    kept = seen.groupBy("n", "x", "m").agg(F.min("group").alias("group")).select("group")
    return groups.join(kept, "group")


def _confirmed(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) that span the exact links of each group."""

    def run(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        raw = part.column("shingles").to_pylist()
        raw = [raw[i] for i in order]
        sizes = np.array([len(x) // 8 for x in raw])
        values, codes = np.unique(np.frombuffer(b"".join(raw), dtype=np.uint64), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(values), dtype=bool)
        n = len(ids)
        left, tails, heads = np.arange(n), [], []
        while len(left):
            seed, left = left[0], left[1:]
            front = [seed]
            while front and len(left):
                one = front.pop()
                own = codes[first[one] : first[one + 1]]
                # Sets whose sizes alone rule the link out are passed over.
                fits = 100 * np.minimum(sizes[left], sizes[one]) >= percent * np.maximum(sizes[left], sizes[one])
                asked = left[fits]
                if not len(asked):
                    continue
                mark[own] = True
                lengths = sizes[asked]
                ends = np.cumsum(lengths)
                places = np.arange(ends[-1]) + np.repeat(first[asked] - (ends - lengths), lengths)
                shared = np.add.reduceat(mark[codes[places]], ends - lengths, dtype=np.int64)
                mark[own] = False
                linked = asked[100 * shared >= percent * (sizes[asked] + sizes[one] - shared)]
                tails.extend(ids[linked].tolist())
                heads.extend([int(ids[seed])] * len(linked))
                front.extend(linked.tolist())
                left = np.setdiff1d(left, linked, assume_unique=True)
        return pa.table({"a": pa.array(tails, pa.int64()), "b": pa.array(heads, pa.int64())})

    return groups.join(sets, "id").groupBy("group").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Full shingle sets of the wanted representatives, as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, rolls = Splitter(lower=True), (Powers(ROLL), Powers(pow(ROLL, -1, 1 << 64)))
        for batch in batches:
            for part in pieces(batch):
                sets, first = shingle_sets(splitter, rolls, part.column(1), shingle)
                blobs = [sets[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)]
                marks = [xxhash.xxh64_intdigest(b) - (1 << 63) for b in blobs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "mark", "shingles"])

    wanted = broadcast_if_small(wanted, BROADCAST_IDS)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    # Rows of one id with unlike texts keep their own sets.
    return texts.mapInArrow(run, "id long, mark long, shingles binary").dropDuplicates(["id", "mark"]).drop("mark")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    found = materialize(profiles(bounded(docs), shingle), "profiles")
    known = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        known.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("r")).select(
            "set_a", "set_b", "n_shingles", F.col("r.doc_id").alias("id"), F.col("r.bands").alias("bands"), F.col("r.bits").alias("bits")
        ),
        "classes",
    )
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("id")).alias("x")).where("members > 1")
    buckets = shared.groupBy("members", "x").agg(F.min("bucket").alias("bucket"))
    buckets = materialize(buckets.select("bucket", F.ceil(F.col("members") / BITS_MEMBERS).cast("int").alias("blocks")), "buckets")
    pruned = materialize(_pruned(_blocks(rows, buckets), classes.select("id", "bits"), percent / 100), "pruned")
    groups = materialize(_candidate_groups(pruned, classes.select("id", "n_shingles")), "candidates")
    stars = _confirmed(groups, _sets(docs, pruned.select("id").distinct(), shingle), percent)
    linked = components(materialize(stars, "stars"))
    heads = classes.select("set_a", "set_b", "n_shingles", "id").join(linked, "id", "left")
    heads = heads.select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("_head"))
    joined = found.select("doc_id", "n_shingles", "set_a", "set_b").join(heads, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("_head", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
