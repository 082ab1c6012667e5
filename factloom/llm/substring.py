"""Removal of passages that repeat between documents, with super-k-mers of words.

A window is a run of ``size`` consecutive words of one document. A word goes if a window that covers
it also starts in a document with a smaller id.

1. One pass over the texts cuts each document into super-k-mers: the longest runs of windows that
   share a minimiser, the smallest hash of their runs of ``SEED`` words. Only (minimiser, document,
   place) travel, to find the minimisers that occur in more than one document. All other windows
   can't repeat.
2. The super-k-mers of shared minimisers, each packed as one string, travel to the bucket of their
   minimiser, where all their windows are sorted and the smallest document of each is found. A
   frequent minimiser is dealt over several buckets by document; what those can't decide alone, the
   first occurrence of each window in each bucket, is dealt again by window hash and sorted there.
3. The removed windows come back per document and the words they cover are left out.

Windows are compared within a minimiser by two 64-bit hashes, each built on another hash of the words' bytes.

Defined cases: null or blank text has no words and keeps an empty text; a document shorter than a
window loses nothing; rows with the same id never remove each other's words and each is cut by its
own windows; rows with a null id take no part and keep their words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import Powers, Splitter, bounded, filled, mixed, pieces, runs, windows
from factloom.session import materialize

SIZE = 50
SEED = 8
# So many super-k-mers of one minimiser share a bucket; more are dealt over several.
BUCKET_ROWS = 256
ROLL_A, ROLL_B = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
KMERS = "row long, doc_id long, minimiser long, start int, n int"
PACKED = "row long, doc_id long, minimiser long, salt int, salts int, start int, packed binary"
FOUND = "row long, doc_id long, start int, n int, minimiser long, sub int, open binary"
MOST_BYTES = 2 << 20


def _second(word: bytes) -> int:
    """A hash of a word's bytes that shares nothing with the first one."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def rolls(base: int) -> tuple[Powers, Powers]:
    return Powers(base), Powers(pow(base, -1, 1 << 64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def super_kmers(words, size: int, roll: tuple[Powers, Powers]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first window, number of windows and minimiser of each super-k-mer of a batch."""
    counts = np.maximum(np.diff(words.first) - size + 1, 0)
    at = runs(words.first[:-1], counts)
    if not len(at):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    hashes = words.hashes
    n = len(hashes)
    up, down = roll[0].upto(n + 1), roll[1].upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    seeds = mixed((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
    least = sliding_minimum(seeds, size - SEED + 1)[at]
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    head = np.flatnonzero(new)
    lengths = np.diff(np.append(head, len(at)))
    return doc[head], at[head] - words.first[doc[head]], lengths, least[head].view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns, the id as ``_doc``, and a hash that tells rows of the same id apart as ``_row``."""
    return docs.withColumns({"_row": F.xxhash64("doc_id", "text"), "_doc": F.col("doc_id").cast("long")})


def _places(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, roll = Splitter(), rolls(ROLL_A)
        for batch in batches:
            for part in pieces(batch):
                doc, start, n, minimiser = super_kmers(splitter(part.column("text")), size, roll)
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row").take(own), part.column("_doc").take(own), pa.array(minimiser), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["row", "doc_id", "minimiser", "start", "n"],
                )

    return rows.select("_row", "_doc", "text").mapInArrow(run, KMERS)


def _packed(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted super-k-mers, each with its words packed as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part in pieces(batch):
                out = [[], [], [], [], [], [], []]
                for row, doc, text, own in zip(*(part.column(c).to_pylist() for c in ("_row", "_doc", "text", "_wanted"))):
                    words = text.encode().split()
                    for w in own:
                        cells = (row, doc, w["minimiser"], w["salt"], w["salts"], w["start"], b" ".join(words[w["start"] : w["start"] + w["n"] + size - 1]))
                        for held, cell in zip(out, cells):
                            held.append(cell)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["row", "doc_id", "minimiser", "salt", "salts", "start", "packed"])

    # All columns go in, so that this join and the last one read one and the same exchange of the texts.
    return rows.join(wanted, ["_row", "_doc"]).mapInArrow(run, PACKED)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by ``keys``, of a few MB or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(weight).nbytes
        if size < MOST_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            change |= values[1:] != values[:-1]
        places = np.flatnonzero(change)
        if len(places):
            cut = int(places[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
        else:
            held = table.to_batches()
        size = sum(b.column(weight).nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorted_windows(key: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by group, content and document, and where a new content begins."""
    order = np.lexsort((doc, b, a, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, new


def _spans(row: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow one another in a document, joined into one span."""
    order = np.lexsort((at, row, doc))
    row, doc, at = row[order], doc[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], doc[head], at[head], np.diff(np.append(head, len(at)))


def _found(row, doc, at, n, open_keys=(), open_subs=(), blobs=()) -> pa.RecordBatch:
    """Decided spans, under their row's hash and part -1, and open windows, under their minimiser and part."""
    k, m = len(row), len(blobs)
    none = lambda count, kind: pa.nulls(count, kind)
    join = lambda left, right: pa.concat_arrays([left, right])
    return pa.RecordBatch.from_arrays(
        [
            join(pa.array(row, pa.int64()), none(m, pa.int64())), join(pa.array(doc, pa.int64()), none(m, pa.int64())),
            join(pa.array(at, pa.int32()), none(m, pa.int32())), join(pa.array(n, pa.int32()), none(m, pa.int32())),
            join(pa.array(row, pa.int64()), pa.array(open_keys, pa.int64())), join(pa.array(np.full(k, -1), pa.int32()), pa.array(open_subs, pa.int32())),
            join(none(k, pa.binary()), pa.array(blobs, pa.binary())),
        ],
        names=["row", "doc_id", "start", "n", "minimiser", "sub", "open"],
    )


def _decided(packed: DataFrame, size: int) -> DataFrame:
    """Per bucket the spans of repeated windows, and of dealt minimisers the windows that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, roll_a, roll_b = Splitter(), rolls(ROLL_A), rolls(ROLL_B)
        for table in whole_groups(batches, ["minimiser", "salt"], "packed"):
            words = splitter(table.column("packed").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()))
            a, at, unit = windows(words.hashes, words.first, size, roll_a)
            b, _, _ = windows(words.hashed(_second), words.first, size, roll_b)
            cell = {c: table.column(c).to_numpy() for c in ("row", "doc_id", "minimiser", "salt", "salts", "start")}
            place = at - words.first[unit] + cell["start"][unit]
            doc, row, salts = cell["doc_id"][unit], cell["row"][unit], cell["salts"][unit]
            group = np.cumsum(np.append(True, (cell["minimiser"][1:] != cell["minimiser"][:-1]) | (cell["salt"][1:] != cell["salt"][:-1])))[unit]
            order, new = _sorted_windows(group, a, b, doc)
            head = np.flatnonzero(new)
            least = doc[order][head][np.cumsum(new) - 1]
            repeated = order[doc[order] > least]
            row_s, doc_s, at_s, n_s = _spans(row[repeated], doc[repeated], place[repeated])
            # Of each window only the rows of the smallest document here may still be decided elsewhere.
            rest = order[doc[order] == least]
            rest = rest[salts[rest] > 1]
            keys, subs, blobs = [], [], []
            if len(rest):
                sub = (a[rest] % salts[rest].astype(np.uint64)).astype(np.int64)
                key = cell["minimiser"][unit][rest]
                by = np.lexsort((sub, key))
                rest, sub, key = rest[by], sub[by], key[by]
                cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])))
                record = np.stack([a[rest].view(np.int64), b[rest].view(np.int64), doc[rest], row[rest], place[rest]], axis=1)
                for low, high in zip(cuts, np.append(cuts[1:], len(rest))):
                    keys.append(int(key[low]))
                    subs.append(int(sub[low]))
                    blobs.append(record[low:high].tobytes())
            yield _found(row_s, doc_s, at_s, n_s, keys, subs, blobs)

    dealt = packed.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt")
    return dealt.mapInArrow(run, FOUND)


def _closed(decided: DataFrame) -> DataFrame:
    """All spans: the decided ones as they are, and those of open windows, sorted per (minimiser, part of the window hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["minimiser", "sub"], "open"):
            parts = table.column("sub").to_numpy()
            yield from table.filter(pa.array(parts < 0)).to_batches()
            table = table.filter(pa.array(parts >= 0))
            if not table.num_rows:
                continue
            blobs = table.column("open").to_pylist()
            lengths = np.array([len(x) // 40 for x in blobs])
            group = np.cumsum(np.append(True, (np.diff(table.column("minimiser").to_numpy()) != 0) | (np.diff(table.column("sub").to_numpy()) != 0)))
            record = np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 5)
            order, new = _sorted_windows(np.repeat(group, lengths), record[:, 0], record[:, 1], record[:, 2])
            doc = record[:, 2][order]
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = order[doc > least]
            yield _found(*_spans(record[again, 3], record[again, 2], record[again, 4]))

    return decided.repartition("minimiser", "sub").sortWithinPartitions("minimiser", "sub").mapInArrow(run, FOUND)


def _repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """(_row, _doc, _spans): per document the runs of windows (start, n) that a smaller document also has."""
    places = materialize(_places(rows, size), "super-kmers")
    shared = places.groupBy("minimiser").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("members")
    ).where("low < high").select("minimiser", F.ceil(F.col("members") / BUCKET_ROWS).cast("int").alias("salts"))
    hits = places.join(shared, "minimiser").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    # A list per document is no longer than the document.
    wanted = hits.groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("minimiser", "salt", "salts", "start", "n")).alias("_wanted"))
    spans = _closed(_decided(_packed(rows, wanted, size), size))
    return spans.groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("start", "n")).alias("_spans"))


def kept_words(text: bytes, spans: list | None, size: int) -> tuple[int, list[bytes]]:
    """Number of words of a text and those that no span covers."""
    words = text.split()
    if not spans or not words:
        return len(words), words
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        cover[s["start"]] += 1
        cover[min(s["start"] + s["n"] + size - 1, len(words))] -= 1
    return len(words), list(compress(words, (np.cumsum(cover)[:-1] == 0).tolist()))


def _with_spans(docs: DataFrame, size: int) -> DataFrame:
    """All columns of ``docs`` and the spans that go, as ``_spans``."""
    keyed = _keyed(bounded(docs))
    known = keyed.where("_doc IS NOT NULL")
    marked = known.join(_repeated_spans(known, size), ["_row", "_doc"], "left").select(*docs.columns, "_spans")
    return marked.unionByName(keyed.where("_doc IS NULL").select(*docs.columns, F.lit(None).cast(marked.schema["_spans"].dataType).alias("_spans")))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the sha256 of the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                total, removed, digest = [], [], []
                for text, spans in zip(filled(part.column("text")).cast(pa.large_binary()).to_pylist(), part.column("_spans").to_pylist()):
                    n, words = kept_words(text, spans, size)
                    total.append(n)
                    removed.append(n - len(words))
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return _with_spans(rows, size).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """All rows and columns of ``docs``; a text that loses words keeps the others, joined by one space, and any other text is as it was."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist()):
                    texts.append(b" ".join(kept_words(text.encode(), spans, size)[1]).decode() if spans and text else text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    return _with_spans(docs, size).mapInArrow(run, docs.schema)
