"""Runs of words that repeat with a period, found with a recompressed grammar of a batch of texts.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at
least ``least`` words and ``times`` periods, that no neighbouring word extends.

1. The words of a batch are numbered, with a number of its own between any two texts, and the whole
   sequence is recompressed (``grammar``). No suffix array is built.
2. Words q apart agree over at least m = max(least - q, (times - 1) q) places in a run. For each
   period q a grid of places, m - GRAM + 1 apart, therefore meets each run of period q at a place
   where GRAM words agree with those q further on. Grid places where they do are the candidates.
3. Extensions of each candidate to both sides, answered by the grammar, give the exact stretch. A
   stretch that several periods have keeps the smallest.

A batch is a few MB of texts, a longer text is a batch of its own; no rows are exchanged.

Defined cases: null and blank texts have no words and no run; rows with the same id are treated one
by one; with ``planted``, rows with a null id keep their words as they are; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.grammar import extensions, mirrored, recompress
from factloom.llm.words import Splitter, bounded, mixed, pieces, runs

LEAST, TIMES = 24, 3
# So many words agree at a candidate.
GRAM = 4
# So many grid places are looked at together.
GRID_ROWS = 1 << 21
RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of every run of texts given as numbered words, by text, start and period."""
    counts = np.diff(first)
    n = len(counts)
    none = (np.empty(0, dtype=np.int64),) * 4
    periods = np.where(counts >= least, counts // times, 0)
    if not periods.any():
        return none
    # Between the texts, and at both ends, stand numbers that occur once.
    text = np.full(len(codes) + n + 1, -1, dtype=np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(n), counts) + 1
    text[place] = codes
    walls = np.flatnonzero(text < 0)
    text[walls] = np.arange(n + 1) + (int(codes.max()) + 1 if len(codes) else 0)
    begin = walls[:-1] + 1
    gram = np.zeros(len(text), dtype=np.uint64)
    for k in range(GRAM):
        gram[: len(text) - k] = mixed(gram[: len(text) - k] ^ text[k:].astype(np.uint64))
    grammar, found = None, []
    for own, period, at in _grid(counts, periods, least, times):
        at = begin[own] + at
        hit = gram[at] == gram[at + period]
        own, period, at = own[hit], period[hit], at[hit]
        if not len(at):
            continue
        if grammar is None:
            grammar = recompress(text, int(counts.max()))
            turned = mirrored(grammar)
        after = extensions(grammar, at, at + period)
        last = len(text) - 1
        before = extensions(turned, last - (at - 1), last - (at + period - 1))
        start, length = at - before, before + period + after
        real = length >= np.maximum(least, times * period)
        found.append(np.stack([start[real], length[real], period[real], own[real]]))
    if not found or not sum(f.shape[1] for f in found):
        return none
    start, length, period, own = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period, own = start[order], length[order], period[order], own[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, length, period, own = start[new], length[new], period[new], own[new]
    order = np.lexsort((period, start))
    return own[order], (start - begin[own])[order], length[order], period[order]


def _grid(counts: np.ndarray, periods: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the grid of every text and period, in parts of bounded size."""
    ends = np.cumsum(periods)
    at = 0
    while at < ends[-1]:
        lane = np.arange(at, min(at + (GRID_ROWS >> 3), ends[-1]))
        own = np.searchsorted(ends, lane, side="right")
        period = lane - (ends - periods)[own] + 1
        step = np.maximum(least - period, (times - 1) * period) - GRAM + 1
        places = np.maximum(-(-(counts[own] - period - GRAM + 1) // step), 0)
        sums = np.cumsum(places)
        take = max(1, int(np.searchsorted(sums, GRID_ROWS, side="right")))
        own, period, step, places = own[:take], period[:take], step[:take], places[:take]
        lanes = np.repeat(np.arange(len(own)), places)
        yield own[lanes], period[lanes], runs(np.zeros(len(own), dtype=np.int64), places) * step[lanes]
        at += take


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the words that make the text periodic from some place on; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def periodic_runs(docs: DataFrame, planted: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document: doc_id, number of runs, the run with the greatest exponent, and digests of all runs and of the text without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for part in pieces(batch):
                yield _described(part, splitter, planted, least, times)

    rows = bounded(docs).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {RUNS}")


def _described(part: pa.RecordBatch, splitter: Splitter, planted: bool, least: int, times: int) -> pa.RecordBatch:
    words = splitter(part.column("text"))
    first = words.first
    order = np.arange(len(words.codes))
    for k, doc_id in enumerate(part.column("doc_id").to_pylist() if planted else ()):
        moved = planted_order(doc_id, int(first[k + 1] - first[k]))
        if moved is not None:
            order[first[k] : first[k + 1]] = first[k] + moved
    own, start, length, period = find_runs(words.codes[order], first, least, times)
    n = part.num_rows
    keep = np.zeros(len(order) + 1, dtype=np.int64)
    np.add.at(keep, first[own] + start + period, 1)
    np.add.at(keep, first[own] + start + length, -1)
    kept = np.cumsum(keep)[:-1] == 0
    places = order[kept]
    data, begin = words.spaced()
    sizes = np.diff(begin)[places]
    text = data[runs(begin[places], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(kept)])[first]].tolist()
    edge = np.searchsorted(own, np.arange(n + 1)).tolist()
    listed = list(zip(start.tolist(), length.tolist(), period.tolist()))
    best, digest = [], []
    for k in range(n):
        mine = listed[edge[k] : edge[k + 1]]
        top = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        best.append((*top, None if top[0] is None else 1000 * top[1] // top[2]))
        digest.append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in mine).encode()).hexdigest())
    collapsed = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]
    columns = [part.column("doc_id"), pa.array(np.diff(edge), pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*best)), pa.array(digest), pa.array(collapsed)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(c.split()[0] for c in RUNS.split(", "))])
