"""Alignment of two tokenizers on the same texts, by lockstep vectorised merging.

A is a byte-level BPE of the tokenizers library on a space and the text, B a sentencepiece model that
adds this space itself. Tokens of both cover the same bytes. Where both end, a group ends; tokens
whose bytes overlap are linked; an id pair counts as often as it is linked in the whole corpus.

1. A batch of texts is cut into chunks before single spaces. No token of A or B reaches over such a
   place, and none is decided by what lies beyond it: A's pattern begins a new piece there, and no
   piece of B has a blank behind another character. So only the distinct chunks of a batch are
   encoded, many in one call, and the texts' tokens are gathered from them.
2. The merge keeps one state vector: a place in A and a place in B for every text of the batch. Each
   step links the two current tokens of all texts, cuts where both end, and moves on the one that
   ends first, or both; texts that are through leave the vector. A long text has several entries in
   it, cut at places of step 1, so that it needs no more steps than others.
3. Each text keeps its distinct id pairs and how often it links them. Pair counts are summed over all
   texts. The ``HELD_PAIRS`` most frequent ones, a fixed bound, are sent to all tasks; the pairs
   of a text beyond them are joined by shuffle, where none of them is frequent.

Defined cases: null and empty texts, and texts whose tokens don't give the bytes back (U+2581 is
read as a blank by B), have no tokens: zeros and an empty string; rows of one id are rows of their
own; null ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encoding import BYTE_OF, kept_by_worker, tokenizer_file, tokenizer_text
from factloom.llm.words import bounded, filled, pieces, runs, values_of
from factloom.session import materialize

HELD_PAIRS = 1_000_000
# Distinct pairs that a task sums before it sends them on.
SUMMED_PAIRS = 500_000
# Bytes of a text per entry of the state vector, and of chunks per string that is encoded.
LANE_BYTES, SLICE_BYTES = 512, 4096
SPACE = 0x20
BLANK_MARK = "\u2581".encode()
# An id of A is below 2^16, one of B below 2^15; a pair is one number.
B_IDS = 1 << 15
TEXT_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
# What may follow a space at which a text is cut: printable ASCII, and first bytes of longer characters of which none is white space.
SOLID = np.zeros(256, dtype=bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xF5] = True
SOLID[0xE1:0xE4] = False


def _digits(size: int) -> np.ndarray:
    """The decimal digits of every id, right-aligned in five bytes, with a sixth for the sign behind them."""
    return np.array([list(str(i).rjust(5, "\0").encode() + b"\0") for i in range(size)], dtype=np.uint8)


class Vocabulary:
    """The bytes of a tokenizer's ids, and how to encode strings."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.digits = _digits(len(entries))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[runs(self.starts[ids], self.lengths[ids])]


class ByteLevel(Vocabulary):
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        parsed = json.loads(definition)
        named = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        entries = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            entries[i] = bytes(BYTE_OF[c] for c in token)
        super().__init__(entries)

    def encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


class Pieces(Vocabulary):
    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK_MARK.decode() in name.lstrip(BLANK_MARK.decode()) for name in names):
            raise ValueError("A piece has a blank behind another character, so texts can't be cut before blanks.")
        super().__init__([bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.encode().replace(BLANK_MARK, b" ") for i, n in enumerate(names)])

    def encode(self, strings: list[str]) -> list[list[int]]:
        """Of strings that begin with the space which the model adds."""
        return self.model.encode([s[1:] for s in strings], num_threads=1)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for ids in lists for i in ids), np.int64, sum(map(len, lists)))


def _encoded(vocabulary: Vocabulary, chunks: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all chunks, the number of ids of each, and whether they give its bytes back.

    Plain chunks are encoded in one string, one after another; the others one by one.
    """
    count = np.zeros(len(chunks), dtype=np.int64)
    good = np.zeros(len(chunks), dtype=bool)
    some = np.flatnonzero(plain)
    sizes = np.array([len(chunks[i]) for i in some.tolist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff((ends - sizes) // SLICE_BYTES)) + 1
    joined = [b"".join(chunks[i] for i in part.tolist()) for part in np.split(some, cuts)] if len(some) else []
    ids = _flat(vocabulary.encode([x.decode() for x in joined]))
    reached = np.cumsum(vocabulary.lengths[ids])
    at = np.searchsorted(reached, ends)
    if len(some) and (reached[-1] != ends[-1] or (reached[at] != ends).any() or vocabulary.spelled(ids).tobytes() != b"".join(joined)):
        alone, ids = np.ones(len(chunks), dtype=bool), ids[:0]
    else:
        count[some] = np.diff(at + 1, prepend=0)
        good[some] = True
        alone = ~plain
    rest = np.flatnonzero(alone)
    own = vocabulary.encode([chunks[i].decode() for i in rest.tolist()])
    for i, found in zip(rest.tolist(), own):
        count[i] = len(found)
        good[i] = vocabulary.spelled(np.array(found, dtype=np.int64)).tobytes() == chunks[i]
    order = np.concatenate([np.flatnonzero(~alone), rest])
    starts = np.empty(len(chunks), dtype=np.int64)
    starts[order] = np.cumsum(count[order]) - count[order]
    return np.concatenate([ids, _flat(own)])[runs(starts, count)], count, good


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Chunks of a space and the text, as codes into the distinct ones, where each text's begin, and at which byte each begins."""
    texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    blank = data == SPACE
    begins = np.zeros(len(data), dtype=bool)
    begins[1:-1] = blank[1:-1] & ~blank[:-2] & SOLID[data[2:]]
    begins[edges[1:-1] - 1] = False  # a space at a text's end
    begins[edges[:-1]] = True
    starts = np.flatnonzero(begins)
    places = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded, np.searchsorted(starts, edges), starts


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (place in A, place in B) and cuts (the same) of all entries of the state vector.

    ``end_*`` hold the byte at which each token ends, ``first_*`` where each entry's tokens begin, one
    more at the end. The tokens of an entry cover the same bytes in A and in B.
    """
    a, b, stop = first_a[:-1], first_b[:-1], first_a[1:]
    on = a < stop
    a, b, stop = a[on], b[on], stop[on]
    links_a, links_b, cuts_a, cuts_b = [a[:0]], [b[:0]], [a[:0]], [b[:0]]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        x, y = end_a[a], end_b[b]
        both = x == y
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (x <= y), b + (y <= x)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    return tuple(np.concatenate(x) for x in (links_a, links_b, cuts_a, cuts_b))


class Aligner:
    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteLevel(definition), Pieces(model)

    def __call__(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """Columns of TEXT_ROWS but row and doc_id, for texts of which none is null or empty."""
        coded, first, starts = cut(texts)
        codes = coded.indices.to_numpy().astype(np.int64)
        chunks = values_of(coded.dictionary)
        plain = np.array([len(c) > 1 and SOLID[c[1]] and c[-1] != SPACE and BLANK_MARK not in c for c in chunks], dtype=bool)
        ids_a, count_a, good_a = _encoded(self.a, chunks, plain)
        ids_b, count_b, good_b = _encoded(self.b, chunks, plain)
        docs = len(first) - 1
        of = np.repeat(np.arange(docs), np.diff(first))
        bad = np.zeros(docs, dtype=bool)
        bad[of[~(good_a & good_b)[codes]]] = True
        solid = ~bad[of]
        codes, of, starts = codes[solid], of[solid], starts[solid]
        # Entries of the state vector: texts, or parts of long ones.
        place = np.zeros(docs, dtype=np.int64)
        head = np.flatnonzero(np.diff(of, prepend=-1))
        place[of[head]] = starts[head]
        lane = (starts - place[of]) // LANE_BYTES
        lanes = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (lane[1:] != lane[:-1]))) if len(of) else head
        sides = []
        for vocabulary, ids, count in ((self.a, ids_a, count_a), (self.b, ids_b, count_b)):
            before = np.concatenate([[0], np.cumsum(count[codes])])
            own = ids[runs((np.cumsum(count) - count)[codes], count[codes])]
            by_doc = before[np.searchsorted(of, np.arange(docs + 1))]
            sides.append((own, np.cumsum(vocabulary.lengths[own]), before[np.append(lanes, len(codes))], by_doc))
        (a, end_a, lane_a, doc_a), (b, end_b, lane_b, doc_b) = sides
        link_a, link_b, cut_a, cut_b = lockstep(end_a, end_b, lane_a, lane_b)
        cut_a.sort()
        cut_b.sort()
        doc = np.repeat(np.arange(docs), np.diff(doc_a))
        links = doc[link_a]
        keyed, times = np.unique((links.astype(np.uint64) << np.uint64(32)) | (a[link_a] * B_IDS + b[link_b]).astype(np.uint64), return_counts=True)
        edge = np.searchsorted(keyed >> np.uint64(32), np.arange(docs + 1)).tolist()
        keys, times = keyed.astype("<u4"), times.astype("<u4")
        return {
            "n_a": np.diff(doc_a), "n_b": np.diff(doc_b), "n_groups": np.bincount(doc[cut_a], minlength=docs), "n_links": np.bincount(links, minlength=docs),
            "groups_sha256": self._digests(a, b, cut_a, cut_b, doc_a, doc_b),
            "pairs": [keys[s:e].tobytes() for s, e in zip(edge, edge[1:])], "times": [times[s:e].tobytes() for s, e in zip(edge, edge[1:])],
        }

    def _digests(self, a, b, cut_a, cut_b, doc_a, doc_b) -> list[str]:
        """Of each text its groups, ``a1,a2|b1;a3|b2,b3``, hashed."""
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[cut_a] = True
        last_b[cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # In the string a token of A stands behind the B tokens of earlier groups, one of B behind the A tokens up to its own group.
        at_a = np.arange(len(a)) + np.concatenate([[0], cut_b + 1])[group_a]
        at_b = np.arange(len(b)) + (cut_a + 1)[group_b]
        cells = np.empty((len(a) + len(b), 6), dtype=np.uint8)
        cells[at_a] = self.a.digits[a]
        cells[at_b] = self.b.digits[b]
        cells[at_a, 5] = np.where(last_a, ord("|"), ord(","))
        cells[at_b, 5] = np.where(last_b, ord(";"), ord(","))
        flat = cells.ravel()
        solid = flat != 0
        text = flat[solid].tobytes()
        ends = np.concatenate([[0], np.cumsum(solid.reshape(-1, 6).sum(axis=1))])[doc_a + doc_b].tolist()
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document with its tokens, groups, links and packed id pairs (TEXT_ROWS)."""
    definition = tokenizer_text(path_a or tokenizer_file("byte_bpe_50k.json"))
    with open(path_b or tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text")
    shared = rows.sparkSession.sparkContext.broadcast((definition, model))  # two tokenizer files, of fixed size
    names = [c.split()[0] for c in TEXT_ROWS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_by_worker(f"aligner_{hash(shared.value) & 0xFFFFFFFFFFFF:x}", lambda: Aligner(*shared.value))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch):
                texts = filled(part.column(1))
                some = pc.not_equal(pc.binary_length(texts), 0)
                solid = np.flatnonzero(some.to_numpy(zero_copy_only=False))
                n = part.num_rows
                cells = {name: np.zeros(n, dtype=np.int64) for name in names[2:6]} | {name: [x] * n for name, x in zip(names[6:], ("", b"", b""))}
                if len(solid):
                    for name, values in aligner(texts.filter(some)).items():
                        if isinstance(values, np.ndarray):
                            cells[name][solid] = values
                        else:
                            for i, value in zip(solid.tolist(), values):
                                cells[name][i] = value
                cells |= {"row": np.arange(row, row + n), "doc_id": part.column(0)}
                row += n
                yield pa.RecordBatch.from_arrays([cells[c] if c == "doc_id" else pa.array(cells[c], k) for c, k in zip(names, kinds)], names=names)

    return rows.mapInArrow(run, TEXT_ROWS)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best) over the whole corpus: how many links hold the pair, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["pair", "n"])
        for batch in batches:
            held, of = np.unique(np.concatenate([keys, _unpacked(batch.column(0))]), return_inverse=True)
            sums = np.bincount(of, np.concatenate([sums, _unpacked(batch.column(1))]), len(held)).astype(np.int64)
            keys = held
            if len(keys) > SUMMED_PAIRS:
                yield out()
                keys, sums = keys[:0], sums[:0]
        yield out()

    counts = texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("b", F.col("pair") % B_IDS), "pair-counts")
    top = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("_top")))  # one row per id of B at most
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _held(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent pairs, about ``limit`` of them at most: whole levels of the count, and of the last level a part by hash."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.col("level").desc()).collect()  # some hundreds of levels
    room, last, share = limit, None, 0
    for r in levels:
        if r["pairs"] > room:
            last, share = r["level"], 1024 * room // r["pairs"]
            break
        room -= r["pairs"]
    if last is None:
        return counts
    return counts.where((level > last) | ((level == last) & (F.pmod(F.xxhash64("pair"), F.lit(1024)) < share)))


def alignment_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = materialize(aligned(docs, path_a, path_b), "aligned")
    counts = materialize(pair_counts(texts), "pairs")
    held = _held(counts, held_pairs).orderBy("pair").toArrow()
    table = tuple(held.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((table[0].astype("<u4"), *table[1:]))  # at most HELD_PAIRS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            row = batch.column(0).to_numpy()
            lengths = pc.binary_length(batch.column(1)).to_numpy() // 4
            keys, times = _unpacked(batch.column(1)), _unpacked(batch.column(2)).astype(np.int64)
            of = np.repeat(np.arange(len(row)), lengths)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)
            where = at[hit]
            total = np.zeros(len(row), dtype=np.int64)
            np.add.at(total, of[hit], times[hit] * n[where])
            top = np.zeros(len(row), dtype=np.int64)
            np.add.at(top, of[hit], times[hit] * best[where])
            rest = np.flatnonzero(~hit)
            nulls = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[of[rest]]])), pa.concat_arrays([nulls(len(row)), pa.array(keys[rest].astype(np.int64))]),
                    pa.concat_arrays([nulls(len(row)), pa.array(times[rest])]),
                    pa.concat_arrays([pa.array(top), nulls(len(rest))]), pa.concat_arrays([pa.array(total), nulls(len(rest))]),
                ],
                names=["row", "pair", "times", "n_best", "count_sum"],
            )

    found = materialize(texts.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long, n_best long, count_sum long"), "links")
    rest = found.where("pair IS NOT NULL").select("row", "pair", "times").join(counts, "pair")
    rest = rest.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = found.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
