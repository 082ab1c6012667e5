"""Recompression of integer sequences into a run-length grammar, and longest common extensions on it.

A sequence is rewritten level by level, alternately by blocks and by pairs. A block level replaces
each longest run of one symbol by one symbol for (symbol, length). A pair level deals the symbols to
a left and a right half by a hash and replaces each left symbol that is followed by a right one,
together with it, by one symbol for the pair. Equal symbols of a level stand for equal parts of the
sequence. About a quarter of a sequence goes with each pair level, so the number of levels is
logarithmic, and all levels together are a small multiple of the sequence.

Equal parts are rewritten alike but for a symbol or a part of a run at their ends. An extension of
two places therefore climbs: at each level it matches what lies before the next place at which both
sequences begin a new symbol (one symbol or one part of a run), and goes on there one level higher,
until symbols differ; then it comes down, matching at most one symbol or run on each level. Many
extensions climb and come down together, as one vector of states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK, PAIR = 0, 1


@dataclass
class Level:
    """One sequence of the grammar and how the next one is made from it."""

    symbols: np.ndarray
    sizes: np.ndarray  # what each symbol stands for, in symbols of the lowest level
    kind: int = BLOCK
    phrase: np.ndarray | None = None  # which symbol of the next level a symbol goes into
    begins: np.ndarray | None = None  # whether it is that symbol's first
    left: np.ndarray | None = None  # of a run: how many symbols from here to its end
    start: np.ndarray | None = None  # per symbol of the next level, its first symbol here


def _halves(symbols: np.ndarray, level: int) -> np.ndarray:
    """Whether a symbol is dealt to the right half."""
    x = (symbols.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)).astype(bool)


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for distinct (first, second)."""
    return np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)[1]


def _numbered(level: Level, begins: np.ndarray) -> np.ndarray:
    level.begins, level.start = begins, np.flatnonzero(begins)
    level.phrase = np.cumsum(begins) - 1
    return level.start


def _block(level: Level) -> Level | None:
    s = level.symbols
    begins = np.ones(len(s), dtype=bool)
    begins[1:] = s[1:] != s[:-1]
    if begins.all():
        return None
    start = _numbered(level, begins)
    lengths = np.diff(np.append(start, len(s)))
    level.kind = BLOCK
    level.left = (start + lengths)[level.phrase] - np.arange(len(s))
    return Level(_named(s[start], lengths), level.sizes[start] * lengths)


def _pair(level: Level, number: int) -> Level | None:
    s = level.symbols
    right = _halves(s, number)
    one, other = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
    heads = np.flatnonzero(one if one.sum() >= other.sum() else other)
    if not len(heads):
        return None
    begins = np.ones(len(s), dtype=bool)
    begins[heads + 1] = False
    start = _numbered(level, begins)
    level.kind = PAIR
    # A symbol that stays alone is paired with nothing, which has the number 0.
    second = np.zeros(len(s), dtype=np.int64)
    second[heads] = s[heads + 1] + 1
    sizes = level.sizes.copy()
    sizes[heads] += level.sizes[heads + 1]
    return Level(_named(s[start], second[start]), sizes[start])


def recompress(symbols: np.ndarray, longest: int) -> list[Level]:
    """The levels of the grammar of a sequence, until a symbol is left or none stands for fewer than ``longest``."""
    levels, number = [Level(symbols, np.ones(len(symbols), dtype=np.int64))], 0
    while len(levels[-1].symbols) > 1 and levels[-1].sizes.min() <= longest:
        number += 1
        made = _block(levels[-1]) if number % 2 else _pair(levels[-1], number)
        if made is not None:
            levels.append(made)
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar read from the end."""
    out = []
    for k, level in enumerate(levels):
        turned = Level(level.symbols[::-1], level.sizes[::-1], level.kind)
        if level.phrase is not None:
            n, above = len(level.symbols), len(levels[k + 1].symbols)
            turned.phrase = (above - 1 - level.phrase)[::-1]
            turned.begins = np.append(True, turned.phrase[1:] != turned.phrase[:-1])
            turned.start = np.flatnonzero(turned.begins)
            if level.left is not None:
                turned.left = np.append(turned.start[1:], n)[turned.phrase] - np.arange(n)
        out.append(turned)
    return out


def extensions(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols from ``one`` and from ``two`` on are the same, for pairs of unlike places.

    A symbol that occurs once must stand between what is compared and the end of the sequence.
    """
    total = np.zeros(len(one), dtype=np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per level: who differs there, and where
    who, x, y = np.arange(len(one)), one.astype(np.int64), two.astype(np.int64)
    for level in levels:
        same = level.symbols[x] == level.symbols[y]
        if level.phrase is None:  # the highest level: symbols one after another
            ended = [(who[~same], x[~same], y[~same])]
            who, x, y = who[same], x[same], y[same]
            while len(who):
                total[who] += level.sizes[x]
                x, y = x + 1, y + 1
                same = level.symbols[x] == level.symbols[y]
                ended.append((who[~same], x[~same], y[~same]))
                who, x, y = who[same], x[same], y[same]
            waiting.append(tuple(np.concatenate(c) for c in zip(*ended)))
            break
        inside = same & ~(level.begins[x] & level.begins[y])
        differ = ~same
        if inside.any():
            at = np.flatnonzero(inside)
            step = np.minimum(level.left[x[at]], level.left[y[at]]) if level.kind == BLOCK else np.ones(len(at), dtype=np.int64)
            total[who[at]] += step * level.sizes[x[at]]
            x[at] += step
            y[at] += step
            differ[at] = level.symbols[x[at]] != level.symbols[y[at]]
        waiting.append((who[differ], x[differ], y[differ]))
        on = ~differ
        who, x, y = who[on], level.phrase[x[on]], level.phrase[y[on]]
        if not len(who):
            break
    who, x, y = (np.empty(0, dtype=np.int64),) * 3
    for k in range(len(waiting) - 1, 0, -1):
        level = levels[k - 1]
        who, x, y = (np.concatenate(c) for c in zip((who, x, y), waiting[k]))
        x, y = level.start[x], level.start[y]
        at = np.flatnonzero(level.symbols[x] == level.symbols[y])
        step = np.minimum(level.left[x[at]], level.left[y[at]]) if level.kind == BLOCK else np.ones(len(at), dtype=np.int64)
        total[who[at]] += step * level.sizes[x[at]]
        x[at] += step
        y[at] += step
    return total
