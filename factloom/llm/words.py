"""Words of a batch of texts as numpy arrays: places, document numbers, codes and 64-bit hashes.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, in UTF-8. Places come from the batch's one byte buffer. Codes number the distinct
words of the batch, compared byte by byte, and only these are hashed (XXH64).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES = 1 << 20
# Bytes of one batch between Spark and a Python worker; ten thousand long texts in one batch would fill a worker.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(max(n, 1), dtype=U)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], U(step), out=out[done : done + take])
        done += take
        step = step * step % (1 << 64)
    return out[:n]


class Powers:
    """Powers that grow on demand and are kept for the next batch."""

    def __init__(self, base: int):
        self.base, self.held = base, powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            self.held = powers(self.base, 1 << (n - 1).bit_length())
        return self.held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of all words, one after another
    ends: np.ndarray  # of each word in these bytes
    first: np.ndarray  # per document the number of its first word, one more at the end
    codes: np.ndarray  # number of each word's value among the distinct ones
    distinct: pa.Array

    @property
    def hashes(self) -> np.ndarray:
        return self.hashed(xxhash.xxh64_intdigest)

    def hashed(self, digest: Callable[[bytes], int]) -> np.ndarray:
        return np.fromiter(map(digest, values_of(self.distinct)), U, len(self.distinct))[self.codes]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space behind each, and where each begins (one more at the end)."""
        n = len(self.ends)
        lengths = np.diff(self.ends, prepend=0)
        out = np.full(len(self.data) + n, 0x20, dtype=np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(n), lengths)] = self.data
        return out, np.concatenate([[0], self.ends + np.arange(1, n + 1)]).astype(np.int64)


class Splitter:
    """Turns string arrays into words."""

    def __init__(self, lower: bool = False):
        self.lower = lower

    def __call__(self, texts: pa.Array) -> Words:
        texts = filled(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None else np.empty(0, np.uint8)
        edges = offsets - low
        if self.lower:
            data = LOWER[data]
        n = len(data)
        solid = np.zeros(n + 1, dtype=bool)
        np.logical_not(BLANK[data], out=solid[:n])
        first = np.zeros(n + 1, dtype=bool)  # a document begins here
        first[edges] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = solid[:n]
        start = np.flatnonzero(solid & (~before | first))
        end = np.flatnonzero(before & (~solid | first))
        packed = np.ascontiguousarray(data[solid[:n]])
        ends = np.cumsum(end - start)
        places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, places, pa.py_buffer(packed)]).dictionary_encode()
        return Words(packed, ends, np.searchsorted(start, edges), coded.indices.to_numpy(), coded.dictionary)


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows, in a session whose batches are bounded in bytes unless it sets its own bound."""
    settings = rows.sparkSession.conf
    if settings.get(BATCH_SETTING, None) is None:
        settings.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows


def values_of(values: pa.Array) -> list:
    """Strings or bytes as Python objects, without a scalar for each on the way."""
    return values.to_numpy(zero_copy_only=False).tolist()


def filled(texts: pa.Array) -> pa.Array:
    """Large-string array in one piece, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()).fill_null("")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES):
    """Slices of a batch that hold about ``limit`` bytes of text each; a longer text is a slice of its own."""
    texts = filled(batch.column(column))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield batch.slice(at, to - at)
        at = to


def windows(hashes: np.ndarray, first: np.ndarray, size: int, rolls: tuple[Powers, Powers]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one document, with its first word and document number."""
    n = len(hashes)
    up, down = rolls[0].upto(n + 1), rolls[1].upto(n + 1)
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum(hashes * up[:n], out=sums[1:])
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = runs(first[:-1], counts)
    return mixed((sums[at + size] - sums[at]) * down[at]), at, doc


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
