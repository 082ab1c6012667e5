"""BPE encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The most frequent chunks of the corpus are counted over all documents, encoded, and compiled into an
automaton whose states are shared by equal suffixes. Each edge carries the number of words that sort
before its branch, so the sum along a path is the word's rank, and the rank finds the word's ids. The
compiled arrays have a bounded size; they are broadcast, and every Python worker maps them from a
file of its own that has no name and needs no cleaning. A batch walks all its distinct chunks through
the automaton together, one byte a step. Chunks outside the lexicon are merged exactly, by rank of
pairs, many words at once.

Defined cases: null and empty texts have no ids and decode to an empty text; texts of any length are
encoded whole; special tokens inside a text are found as the tokenizers library finds them; repeated
rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import mmap
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encoding import LETTER_OF, Encoder, Ragged, kept_by_worker, split, tokenizer_text
from factloom.llm.words import bounded, filled, pieces, runs
from factloom.session import materialize

LEXICON_WORDS = 60_000
# Longer words are left to the exact merge, which bounds the automaton.
LEXICON_WORD_BYTES = 48
NEVER = np.int64(1) << 40
LONG_WORD = 192
CELLS = 1 << 20
COUNTED_AT_ONCE = 250_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the space-separated chunks of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                flat = pc.ascii_split_whitespace(filled(part.column(0))).flatten()
                found = pc.value_counts(flat)
                new = pa.table({"word": found.field("values"), "n": found.field("counts")})
                held = new if held is None else pa.concat_tables([held, new]).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > COUNTED_AT_ONCE:
                    yield from held.cast(schema).to_batches(max_chunksize=50_000)
                    held = None
        if held is not None:
            yield from held.cast(schema).to_batches(max_chunksize=50_000)

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return docs.select("text").mapInArrow(run, "word string, n long").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent chunks: those above the lowest frequency level at which at most ``most`` remain."""
    counts = materialize(word_counts(docs).where(F.octet_length("word") <= LEXICON_WORD_BYTES).withColumn("level", F.floor(F.log2("n") * 16)), "word-counts")
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    total, least = 0, None
    for level, words in levels:
        if total + words > most:
            break
        total, least = total + words, level
    return [] if least is None else [r["word"] for r in counts.where(F.col("level") >= least).select("word").collect()]


class PairMerger:
    """Exact byte-pair merges of many words at once: in every step each word merges its first pair of least rank."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), results[order]
        self.inner = np.array([vocab[LETTER_OF[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[LETTER_OF[b] + "</w>"] for b in range(256)], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it is none, or a side is missing) and its place in the tables."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.ranks[at], NEVER), at

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        out = Ragged()
        place = np.empty(len(raw), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > LONG_WORD:
                ids = self.long(data[starts[order[at]] : starts[order[at]] + width])
                place[order[at]] = out.extend(ids, np.array([len(ids)]))
                at += 1
                continue
            limit = min(max(width + 3, width * 5 // 4), LONG_WORD)
            to = int(np.searchsorted(lengths[order], limit, side="right"))
            to = min(to, at + max(1, CELLS // limit))
            pick = order[at:to]
            ids, counts = self.short(data, starts[pick], lengths[pick])
            first = out.extend(ids, counts)
            place[pick] = np.arange(first, first + len(pick))
            at = to
        return out.gather(place)

    def short(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(starts), int(lengths.max())
        column = np.arange(width)
        inside = column < lengths[:, None]
        bytes_ = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        ends = column == lengths[:, None] - 1
        symbols = np.where(inside, np.where(ends, self.last[bytes_], self.inner[bytes_]), -1)
        result = np.full((n, width), -1, dtype=np.int64)
        rows = np.arange(n)
        ranks = np.full((n, width), NEVER, dtype=np.int64)
        if width > 1:
            ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])[0]
        while len(rows):
            best = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            done = ranks[line, best] == NEVER
            if done.any():
                result[rows[done], : symbols.shape[1]] = symbols[done]
                rows, symbols, ranks, best = rows[~done], symbols[~done], ranks[~done], best[~done]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            _, at = self.rank(symbols[line, best], symbols[line, best + 1])
            merged = self.results[at]
            w = symbols.shape[1]
            source = np.minimum(np.arange(w - 1) + (np.arange(w - 1) > best[:, None]), w - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            symbols[line, best] = merged
            after = np.minimum(best + 1, w - 2)
            ranks[line, best] = np.where(best + 1 < w - 1, self.rank(merged, symbols[line, after])[0], NEVER)
            some = best > 0
            ranks[line[some], best[some] - 1] = self.rank(symbols[line[some], best[some] - 1], merged[some])[0]
        return result[result >= 0].astype(np.uint32), (result >= 0).sum(axis=1)

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        """Rank and result by pair, made once for all long words."""
        return {k: (r, v) for k, r, v in zip(self.keys.tolist(), self.ranks.tolist(), self.results.tolist())}

    def long(self, data: np.ndarray) -> np.ndarray:
        """One long word with a queue of pairs by rank and place."""
        symbols = self.inner[data].tolist()
        symbols[-1] = int(self.last[data[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, _ = self.rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        queue = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r < NEVER]
        heapq.heapify(queue)
        table = self.table
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i] = table[a << 20 | b][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    found = table.get(symbols[left] << 20 | symbols[right])
                    if found:
                        heapq.heappush(queue, (found[0], left, symbols[left], symbols[right]))
        return np.array([s for s in symbols if s >= 0], dtype=np.uint32)


def compile_lexicon(words: list[str], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The minimal automaton of the words and their ids, as one block of bytes.

    Words are added in sorted order; a state is frozen, and replaced by an equal frozen one, as soon as
    no later word can pass through it.
    """
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # unfinished states of the last word: final, [(byte, target)]
    last = b""
    for i in order:
        word = words[i].encode()
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            state = path.pop()
            path[-1][1].append((last[depth - 1], freeze(*state)))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        state = path.pop()
        path[-1][1].append((last[depth - 1], freeze(*state)))
    root = freeze(*path[0])
    below = np.zeros(len(frozen), dtype=np.int64)  # words from a state on; targets are frozen before their sources
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(frozen):
        count = int(final)
        for byte, target in edges:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(count)
            count += int(below[target])
        below[state] = count
    lists = Ragged()
    lists.extend(ids, lengths)
    sorted_ids, sorted_lengths = lists.gather(np.array(order, dtype=np.int64)) if order else (ids, lengths)
    parts = [
        np.array([len(keys), len(frozen), len(order), len(sorted_ids), root], dtype=np.int64),
        np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int64), np.array(skips, dtype=np.int64),
        np.array([f for f, _ in frozen], dtype=np.int64),
        np.concatenate([[0], np.cumsum(sorted_lengths)]).astype(np.int64), sorted_ids.astype(np.int64),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # has no name; the mapping outlives the handle
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        cells = np.frombuffer(self.map, dtype=np.int64)
        edges, states, words, ids, self.root = cells[:5].tolist()
        ends = np.cumsum([5, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.skips, self.final, self.first, self.ids = (cells[a:b] for a, b in zip(ends[:-1], ends[1:]))

    def find(self, words: pa.Array) -> np.ndarray:
        """Rank of each word in the lexicon, or -1."""
        words = filled(words)
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        raw = words.buffers()[2]
        found = np.full(len(words), -1, dtype=np.int64)
        if raw is None or not len(self.keys):
            return found
        data = np.frombuffer(raw, dtype=np.uint8)
        lengths = np.diff(offsets)
        live = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_WORD_BYTES))
        state = np.full(len(live), self.root)
        total = np.zeros(len(live), dtype=np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, total = live[ok], at[ok], total[ok]
            state = self.targets[at]
            total = total + self.skips[at]
            step += 1
            end = lengths[live] == step
            hit = end & (self.final[state] == 1)
            found[live[hit]] = total[hit]
            live, state, total = live[~end], state[~end], total[~end]
        return found


class TransducerEncoder:
    """Ids of texts: the lexicon first, exact merges for the rest."""

    def __init__(self, definition: str, block: bytes):
        import json

        model = json.loads(definition)["model"]
        self.lexicon = Lexicon(block)
        self.rest = Encoder(definition, PairMerger(model["vocab"], model["merges"]))
        size = len(self.rest.closes)
        tokens = [""] * size
        for token, i in (*model["vocab"].items(), *self.rest.special.items()):
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, chunks, ends = split(texts)
        rank = self.lexicon.find(pa.array(chunks, pa.large_string()))
        missed = np.flatnonzero(rank < 0)
        lengths = np.zeros(len(chunks), dtype=np.int64)
        starts = np.zeros(len(chunks), dtype=np.int64)
        hit = np.flatnonzero(rank >= 0)
        first = self.lexicon.first
        starts[hit] = first[rank[hit]]
        lengths[hit] = first[rank[hit] + 1] - first[rank[hit]]
        other, other_lengths = self.rest.merge_chunks([chunks[i] for i in missed.tolist()])
        starts[missed] = len(self.lexicon.ids) + np.cumsum(other_lengths) - other_lengths
        lengths[missed] = other_lengths
        ids = np.concatenate([self.lexicon.ids, other])
        counts = lengths[codes]
        return ids[runs(starts[codes], counts)].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])[ends]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The tokens of each text, with the tokenizer's separator between them."""
        tokens = self.tokens.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), tokens), pa.scalar(" ", pa.large_string()))


def encode_and_decode(docs: DataFrame, path: str | None = None, most: int = LEXICON_WORDS, ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the ids and the decoded text."""
    definition = tokenizer_text(path)
    rows = bounded(docs).select("doc_id", "text")
    words = frequent_words(rows, most)
    found, lengths = Encoder(definition).merge_chunks(words)
    context = rows.sparkSession.sparkContext
    block = compile_lexicon(words, found, lengths)
    shared = context.broadcast((definition, block))  # at most ``most`` words
    key = "transducer_" + hashlib.sha256(definition.encode() + block).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(key, lambda: TransducerEncoder(*shared.value))
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                flat, first = encoder.encode(part.column(1))
                texts = encoder.decode(flat, first)
                raw = flat.astype("<u4").view(np.uint8)
                columns = [
                    part.column(0), pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in texts], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32))), texts.cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return rows.mapInArrow(run, schema)
