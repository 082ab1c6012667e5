"""Periodic runs, SimHash and tokenizer alignment against plain-Python versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from corpus_cases import documents, lowered, prose, texts, words

from factloom.llm import aligned, periodic, simhash
from factloom.llm.encoding import tokenizer_file
from factloom.llm.grammar import extensions, mirrored, recompress


def repeating() -> list[tuple[int | None, str | None]]:
    """Texts with runs of many periods, nested, adjacent, at the ends, and just too short."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        out: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            base = prose(rng, rng.randrange(1, 14), rng.choice([2, 5, 4000]))
            out += (base * rng.randrange(1, 14))[: rng.randrange(1, 90)] + prose(rng, rng.randrange(0, 4))
        rows.append((1000 + i, " ".join(out)))
    return [*rows, (2000, "a " * 23), (2001, "a " * 24), (2002, "a\tb\n" * 12), (2003, "x " * 3000), (2004, "a b c d e f g h " * 3)]


def plain_runs(w: list[str]) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_periodic(doc_id, text, planted=True):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        str(doc_id), len(found), s, m, q, None if s is None else 1000 * m // q,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_extensions_are_exact():
    rng = np.random.default_rng(3)
    for t in range(60):
        n = int(rng.integers(2, 90))
        s = rng.integers(0, int(rng.integers(1, 4)), n)
        if t % 2:
            s = np.resize(s[: max(1, n // 7)], n)
        whole = np.concatenate([[100], s, [101]])
        grammar = recompress(whole, n)
        one, two = (x[x0 != x1] for x0, x1 in [np.meshgrid(np.arange(1, n + 1), np.arange(1, n + 1))] for x in (x0, x1))
        after = extensions(grammar, one, two).tolist()
        before = extensions(mirrored(grammar), n + 1 - one, n + 1 - two).tolist()
        for i, j, f, b in zip(one.tolist(), two.tolist(), after, before):
            assert (whole[i : i + f] == whole[j : j + f]).all() and whole[i + f] != whole[j + f]
            assert (whole[i - b + 1 : i + 1] == whole[j - b + 1 : j + 1]).all() and whole[i - b] != whole[j - b]


@pytest.mark.parametrize("grid_rows", [1 << 21, 64])
def test_periodic_runs(spark, monkeypatch, grid_rows):
    monkeypatch.setattr(periodic, "GRID_ROWS", grid_rows)
    rows = [r for r in texts() if r[0] not in (600,)] + repeating()
    found = sorted(tuple(str(x) if k == 0 else x for k, x in enumerate(r)) for r in periodic.periodic_runs(documents(spark, rows), planted=True).collect())
    assert found == sorted(plain_periodic(i, t) for i, t in rows)
    assert sum(r[1] for r in found) > 60
    assert periodic.periodic_runs(documents(spark, []), planted=True).collect() == []


def plain_fingerprint(text: str | None, size: int = 4) -> int:
    w = words(lowered(text or ""))
    s = [w] if 0 < len(w) < size else [w[i : i + size] for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_classes(prints: list[tuple[int | None, int]], bits: int) -> dict[int, int]:
    known = [(i, f) for i, f in prints if i is not None]
    parent = {i: i for i, _ in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, f) in enumerate(known):
        for b, g in known[k + 1 :]:
            if (f ^ g).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("members", [1024, 8])
def test_simhash_classes(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rows = texts()
    wanted = plain_classes([(i, plain_fingerprint(t)) for i, t in rows], 4)
    found = simhash.near_by_simhash(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in rows)
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else wanted[r["doc_id"]])
    assert simhash.near_by_simhash(documents(spark, [])).collect() == []


@pytest.mark.parametrize(("members", "small"), [(1024, 32), (6, 3), (40, 2)])
def test_close_fingerprints_are_all_linked(spark, monkeypatch, members, small):
    """Clusters around heads, chains, fingerprints at just the limit, and one bucket that all share."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(260):
        f = rng.choice(prints[:5] if rng.random() < 0.5 else prints)
        for k in rng.sample(range(64), rng.randrange(1, 7)):
            f ^= 1 << k
        prints.append(f)
    prints += [rng.getrandbits(20) for _ in range(80)] + prints[:10]
    rows = list(enumerate(prints, 10))
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    found = {r["fp"] & (1 << 64) - 1: r["component"] for r in simhash.similar_fingerprints(table, 4).collect()}
    wanted = plain_classes(rows, 4)
    assert {i: found[f] for i, f in rows} == wanted
    assert len(set(wanted.values())) < len(set(prints))


def test_every_close_pair_shares_a_mask():
    masks = simhash.block_masks(4)
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(500):
        change = sum(1 << k for k in rng.sample(range(64), 4))
        assert any(not change & m for m in masks)


def alignment_cases() -> list[tuple[int | None, str | None]]:
    odd = ["a", " ", "  a  b ", "a\n b\tc  d\r\n\r\n e", "x\u2581y z", "\u2581", "a\u00a0 b\u3000 c \u00a0d", "naïve “quoted” text’s end", "<s> <|endoftext|> </s> <0x41>", "日本語 テキスト 😀😀", "\x00 a\x1cb", "it's we'll I'D", "tail ", "\ttab", "1234567 89,000.50", "a" * 3000, "if x:\n        return    y\n"]
    return [*texts(), *((3000 + k, t) for k, t in enumerate(odd))]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    letters = {c: x for c, x in aligned.BYTE_OF.items()}
    pairs, out = Counter(), []
    for i, t in rows:
        if not t:
            out.append((i, None))
            continue
        ids_a = a.encode(" " + t, add_special_tokens=False).ids
        ids_b = b.encode(t)
        raw_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([x - 3]) if b.is_byte(x) else b.id_to_piece(x).replace("\u2581", " ").encode() for x in ids_b]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            out.append((i, None))
            continue
        spans = [list(zip([0, *np.cumsum([len(x) for x in raw])[:-1].tolist()], np.cumsum([len(x) for x in raw]).tolist())) for raw in (raw_a, raw_b)]
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, k, m = [], [], 0, 0
        for edge in both:
            x, y = k, m
            while k < len(ids_a) and spans[0][k][1] <= edge:
                k += 1
            while m < len(ids_b) and spans[1][m][1] <= edge:
                m += 1
            groups.append(",".join(map(str, ids_a[x:k])) + "|" + ",".join(map(str, ids_b[y:m])))
            links += [(ids_a[p], ids_b[q]) for p in range(x, k) for q in range(y, m) if spans[0][p][0] < spans[1][q][1] and spans[1][q][0] < spans[0][p][1]]
        pairs.update(links)
        out.append((i, (len(ids_a), len(ids_b), groups, links)))
    top: dict[int, int] = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    for i, found in out:
        if found is None:
            yield (str(i), 0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = found
            yield (str(i), n_a, n_b, len(groups), len(links), sum(pairs[x] == top[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.mark.parametrize("held", [1_000_000, 40, 0])
def test_alignment(spark, monkeypatch, held):
    monkeypatch.setattr(aligned, "LANE_BYTES", 512 if held else 40)
    rows = alignment_cases()
    found = sorted((str(r[0]), *r[1:]) for r in aligned.alignment_table(documents(spark, rows), held_pairs=held).collect())
    assert found == sorted(plain_alignment(rows))
    assert sum(r[4] for r in found) > 10_000


def test_alignment_of_nothing(spark):
    assert aligned.alignment_table(documents(spark, [])).collect() == []


def test_chunks_that_do_not_come_back_are_encoded_alone(monkeypatch):
    vocabulary = aligned.ByteLevel(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read())
    chunks = [b" one", b" two two", b" three\n"]
    plain = np.array([True, True, False])
    ids, count, good = aligned._encoded(vocabulary, chunks, plain)
    monkeypatch.setattr(aligned, "SLICE_BYTES", 4)
    again = aligned._encoded(vocabulary, chunks, plain)
    assert good.all() and all((x == y).all() for x, y in zip((ids, count, good), again))
    wrong = aligned._encoded(vocabulary, [b" one", b"a", b"b"], np.array([True, True, True]))  # "ab" is one token, across the chunks
    assert wrong[2].all() and wrong[1].tolist() == [1, 1, 1]
