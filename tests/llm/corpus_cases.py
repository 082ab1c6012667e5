"""A small corpus with the awkward cases, and plain-Python versions of the operators' definitions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, `group` string, bucket long, component long, start int, n int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, n: int, stock: int = 4000) -> list[str]:
    return [f"w{rng.randrange(stock):x}{rng.choice(['', '', ',', '.', 'é'])}" for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(60, 160)) for _ in range(12)]
    passage = prose(rng, 70)
    rows: list[tuple[int | None, str | None]] = []
    for i, b in enumerate(base):
        rows.append((100 + i, " ".join(b)))
    for i in range(8):  # exact copies, in other case and spacing
        rows.append((200 + i, "  ".join(base[0]).upper().replace("É", "é") if i % 2 else " ".join(base[0])))
    for i in range(30):  # near copies, some of them chained through others
        near = list(base[1])
        for _ in range(rng.randrange(0, 5)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(near)))
    for i in range(12):  # a passage that many share
        rows.append((400 + i, " ".join(prose(rng, rng.randrange(0, 40)) + passage + prose(rng, rng.randrange(0, 40)))))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "!!! ... ???"), (504, "one two"), (505, "one two"), (506, "One Two"), (507, "a"), (508, "123 456")]
    rows.append((600, " ".join(prose(rng, 30_000))))
    rows += [(None, " ".join(base[2])), (None, None), (700, " ".join(base[3])), (700, " ".join(base[3])), (50, " ".join(passage))]
    rows += [(800, "x" * 5000 + " " + "ab" * 300), (801, "naïve Ünï 日本語 😀 <|endoftext|>a b İ ΑΣ. it's DON'T   x\x1cy é")]
    return rows


def documents(spark, rows=None):
    """The rows as a table with the usual columns and some whose names clash with inner ones."""
    rows = texts() if rows is None else rows
    cells = [(i, t, "en" if k % 2 else "de", f"s{k % 3}", None if t is None else len(t), -k, "g", k, k, 7, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(cells, SCHEMA).repartition(3)


def shingles(text: str | None, size: int) -> frozenset:
    w = words(lowered(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def near_classes(rows, size: int, percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def removed(rows, size: int) -> list[tuple[int | None, int, list[str]]]:
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), [x for x, g in zip(w, gone) if not g]))
    return out
