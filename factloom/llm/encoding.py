"""Token ids of whole texts with a public word tokenizer, at the cost of its distinct words.

The tokenizer lower-cases, drops white space and never joins pieces across it, so a text's ids are
those of its space-separated chunks, one after another. A batch is split at ASCII white space,
its distinct chunks are looked up in a table that a worker keeps, and only new chunks go through
the tokenizers library, many in one call. ``Encoder`` gives the same ids as the library's ``encode``
with ``add_special_tokens=False``.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

from factloom.llm.words import Splitter, runs, values_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
# Chunks that a worker remembers before it lets go of the rarer ones, and pieces before it starts afresh.
MOST_HELD = 400_000
PIECES_AT_ONCE = 100
# Up to this code point all Unicode versions agree on case and classes; other chunks go to the library whole.
PLAIN_LAST = "\u052f"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's definition, read where the job is started; it is small and of fixed size."""
    with open(path or tokenizer_file(), encoding="utf-8") as f:
        return f.read()


def kept_by_worker(key: str, make: Callable):
    """One object per Python worker, kept between tasks."""
    store = sys.modules.setdefault("_factloom_worker_store", types.ModuleType("_factloom_worker_store"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


class Ragged:
    """Id lists stored one after another in a growing array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.start = np.empty(1 << 14, dtype=np.int64)
        self.length = np.empty(1 << 14, dtype=np.int64)
        self.used = self.count = 0

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Add lists; gives the number of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.count
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used += len(ids)
        self.count += len(lengths)
        return first

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered lists one after another, and their lengths."""
        lengths = self.length[numbers]
        return self.ids[runs(self.start[numbers], lengths)], lengths


class Encoder:
    """Ids of chunks; ``merge`` turns a list of new pieces into (ids, lengths)."""

    def __init__(self, definition: str, merge: Callable | None = None):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        parsed = json.loads(definition)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.vocab = parsed["model"]["vocab"]
        self.whole = Tokenizer.from_str(definition)
        self.pieces = Tokenizer.from_str(definition)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.merge = merge or self._library_merge
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.closes = np.zeros(size, dtype=bool)
        self.closes[[i for t, i in self.vocab.items() if t.endswith(END_OF_WORD)]] = True
        self.pattern = regex.compile(PATTERN + r"|\n")  # chunks stand on lines of their own
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.lists = Ragged()
        self.uses = np.zeros(1 << 14, dtype=np.int64)
        self.forget_pieces()

    def forget_pieces(self) -> None:
        self.known: dict[str, int] = {}
        self.piece_lists = Ragged()

    def forget_rare(self) -> None:
        """Keep the chunks of most batches, half of what may be held at most."""
        uses = self.uses[: self.lists.count]
        least = max(2, int(np.partition(uses, -(MOST_HELD // 2))[-(MOST_HELD // 2)]) + 1) if len(uses) > MOST_HELD // 2 else 2
        kept = [(c, i) for c, i in self.chunks.items() if uses[i] >= least]
        numbers = np.array([i for _, i in kept], dtype=np.int64)
        ids, lengths = self.lists.gather(numbers)
        self.lists = Ragged()
        self.lists.extend(ids, lengths)
        self.chunks = {c: i for i, (c, _) in enumerate(kept)}
        aged = uses[numbers] // 2
        self.uses = np.zeros(len(self.lists.start), dtype=np.int64)
        self.uses[: len(aged)] = aged

    def _library_merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + PIECES_AT_ONCE]) for i in range(0, len(words), PIECES_AT_ONCE)]
        found = self.pieces.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
        ends = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _new_chunks(self, chunks: list[str]) -> None:
        """Encode chunks that are seen for the first time."""
        strange = [c for c in chunks if "<|" in c or not c.isascii() and max(c) > PLAIN_LAST]
        odd = set(strange)
        plain = [c for c in chunks if c not in odd] if odd else chunks
        if plain:
            joined = unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower()
            flat = self.pattern.findall(joined + "\n")
            breaks = np.array([i for i, w in enumerate(flat) if w == "\n"], dtype=np.int64)
            flat = [w for w in flat if w != "\n"]
            fresh = [w for w in dict.fromkeys(flat) if w not in self.known]
            if fresh:
                ids, lengths = self.merge(fresh)
                first = self.piece_lists.extend(ids, lengths)
                self.known.update(zip(fresh, range(first, first + len(fresh))))
            numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            ids, lengths = self.piece_lists.gather(numbers)
            sums = np.concatenate([[0], np.cumsum(lengths)])
            first = self.lists.extend(ids, np.diff(sums[breaks - np.arange(len(breaks))], prepend=0))
            self.chunks.update(zip(plain, range(first, first + len(plain))))
        for chunk in strange:
            ids = self._strange(chunk)
            self.chunks[chunk] = self.lists.extend(np.array(ids, dtype=np.uint32), np.array([len(ids)], dtype=np.int64))

    def _strange(self, chunk: str) -> list[int]:
        """A chunk with a special token or a rare character: the library splits it, ``merge`` joins its pieces."""
        out: list[int] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for mapped, _ in self.whole.pre_tokenizer.pre_tokenize_str(text):
                    ids, _ = self.merge([raw_piece(mapped)])
                    out.extend(ids.tolist())
        return out

    def merge_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another, and their lengths."""
        numbers = self.numbers(chunks)  # first: it may replace the lists by those of fewer chunks
        return self.lists.gather(numbers)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """List numbers of distinct chunks."""
        if len(self.chunks) > MOST_HELD:
            self.forget_rare()
        if len(self.known) > MOST_HELD:
            self.forget_pieces()
        found = np.array(list(map(self.chunks.get, chunks, repeat(-1))), dtype=np.int64)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            new = [chunks[i] for i in missed.tolist()]
            self._new_chunks(new)
            found[missed] = np.fromiter(map(self.chunks.__getitem__, new), np.int64, len(new))
        if len(self.uses) < self.lists.count:
            self.uses = np.concatenate([self.uses, np.zeros(len(self.lists.start) - len(self.uses), dtype=np.int64)])
        self.uses[found] += 1
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids begin (one more at the end)."""
        codes, chunks, ends = split(texts)
        ids, lengths = self.lists_of(codes, chunks)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[ends]

    def lists_of(self, codes: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.numbers(chunks)
        return self.lists.gather(numbers[codes])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Only the number of ids of each text."""
        codes, chunks, ends = split(texts)
        numbers = self.numbers(chunks)
        return np.diff(np.concatenate([[0], np.cumsum(self.lists.length[numbers][codes])])[ends])


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Chunks of all texts as codes into their distinct values, and where each text's chunks begin."""
    words = Splitter()(texts)
    return words.codes, values_of(words.distinct.cast(pa.large_string())), words.first


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte: itself where it is printable, else the next letter from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + n)] = b
    return letters


BYTE_OF = _byte_letters()
LETTER_OF = {b: c for c, b in BYTE_OF.items()}


def raw_piece(mapped: str) -> str:
    return bytes(BYTE_OF[c] for c in mapped).decode()


def shared_encoder(definition: str) -> Encoder:
    return kept_by_worker(f"encoder_{hash(definition) & 0xFFFFFFFFFFFF:x}", lambda: Encoder(definition))
