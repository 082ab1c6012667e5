"""Operators on texts against plain-Python versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from corpus_cases import documents, near_classes, removed, shingles, texts
from oracle import duck

from factloom.llm import idfiles, lengths, neardup, packing, queries, substring, transducer
from factloom.llm.encoding import Encoder, tokenizer_text
from factloom.llm.links import components


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_text())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 300)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}


@pytest.mark.parametrize("block", [256, 4])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BITS_MEMBERS", block)
    monkeypatch.setattr(neardup, "SET_MEMBERS", block)
    rows = texts()
    wanted = near_classes(rows, 4)
    sizes = {i: len(shingles(t, 4)) for i, t in rows}
    found = neardup.near_duplicates(documents(spark, rows), shingle=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (wanted[r["doc_id"]], sizes[r["doc_id"]], wanted[r["doc_id"]] == r["doc_id"])
    assert max(Counter(wanted.values()).values()) > 20


def test_near_copies_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, []), 5).collect() == []


def test_agreements_count_equal_nibbles():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 16, 128, dtype=np.uint8), rng.integers(0, 16, (5, 128), dtype=np.uint8)
    pack = lambda x: np.ascontiguousarray(x[..., 0::2] | (x[..., 1::2] << 4)).view(np.uint64)
    assert neardup.agreements(pack(a), pack(b)).tolist() == (a == b).sum(axis=1).tolist()


@pytest.mark.parametrize("bucket_rows", [256, 3])
def test_repeated_passages(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(substring, "BUCKET_ROWS", bucket_rows)
    rows = texts()
    wanted = sorted(((str(i), n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in removed(rows, 50)))
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(documents(spark, rows), 50).collect())
    assert found == wanted
    assert sum(r[2] for r in found) > 1000


def test_passages_are_cut_from_the_text(spark):
    rows = texts()
    wanted = sorted((str(i), " ".join(k) if len(k) < n else str(t)) for (i, n, k), (_, t) in zip(removed(rows, 50), rows))
    docs = documents(spark, rows)
    cut = substring.without_repeats(docs, 50)
    assert cut.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in cut.collect()) == wanted
    assert substring.without_repeats(documents(spark, []), 50).collect() == []


def test_encoders_agree_with_the_library(tokenizer):
    rows = [t for _, t in texts()]
    definition = tokenizer_text()
    plain = Encoder(definition)
    chunks = sorted({w for t in rows for w in (t or "").split() if len(w.encode()) <= transducer.LEXICON_WORD_BYTES})[::3]
    block = transducer.compile_lexicon(chunks, *Encoder(definition).merge_chunks(chunks))
    tree = transducer.TransducerEncoder(definition, block)
    assert tree.lexicon.find(pa.array(chunks)).tolist() == sorted(range(len(chunks)), key=lambda i: chunks[i].encode())
    assert tree.lexicon.find(pa.array(["", "w", "zzzz", chunks[0] + "q"])).tolist() == [-1] * 4
    for encoder in (plain, tree, transducer.TransducerEncoder(definition, transducer.compile_lexicon([], *Encoder(definition).merge_chunks([])))):
        flat, first = encoder.encode(pa.array(rows))
        for i, t in enumerate(rows):
            assert flat[first[i] : first[i + 1]].tolist() == ids_of(tokenizer, t)
    flat, first = tree.encode(pa.array(rows))
    for t, decoded in zip(rows, tree.decode(flat, first).to_pylist()):
        assert decoded == tokenizer.decode(ids_of(tokenizer, t), skip_special_tokens=False)


def test_merges_of_short_and_long_words(tokenizer):
    import json

    model = json.loads(tokenizer_text())["model"]
    merger = transducer.PairMerger(model["vocab"], model["merges"])
    words = ["a", "hello", "internationalization", "aaaaaaa", "abcab" * 60, "!" * 400, "ñandú", "x" * 191, "x" * 193]
    ids, counts = merger(words)
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends):
        assert ids[a:b].tolist() == ids_of(tokenizer, w)


def test_ids_after_rare_chunks_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr("factloom.llm.encoding.MOST_HELD", 40)
    rng = random.Random(3)
    encoder = transducer.TransducerEncoder(tokenizer_text(), transducer.compile_lexicon([], np.empty(0, np.uint32), np.empty(0, np.int64)))
    for _ in range(12):
        rows = [" ".join(f"{rng.choice(['the', 'it’s', 'naïve'])} x{rng.randrange(10**6)}q" for _ in range(8)) for _ in range(10)]
        flat, first = encoder.encode(pa.array(rows))
        assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [ids_of(tokenizer, t) for t in rows]


def test_encode_and_decode(spark, tokenizer):
    rows = texts()
    found = transducer.encode_and_decode(documents(spark, rows), most=500, ids=True).collect()
    wanted = Counter((i, tuple(ids_of(tokenizer, t))) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == wanted
    for r in found:
        text = tokenizer.decode(r["ids"], skip_special_tokens=False)
        assert (r["n_tokens"], r["decoded"]) == (len(r["ids"]), text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert transducer.encode_and_decode(documents(spark, [])).collect() == []


def test_frequent_words_are_the_most_frequent(spark):
    rows = texts()
    counts = Counter(w for _, t in rows for w in (t or "").split() if len(w.encode()) <= transducer.LEXICON_WORD_BYTES and "\x1c" not in w and " " not in w)
    found = transducer.frequent_words(documents(spark, rows), 50)
    assert 0 < len(found) <= 50
    assert min(counts[w] for w in found) >= max(n for w, n in counts.items() if w not in set(found))


def test_length_table(spark, tokenizer):
    rows = texts()
    sizes = np.array([len(ids_of(tokenizer, t)) for _, t in rows])
    table = lengths.length_table(lengths.histogram(lengths.encoded_lengths(documents(spark, rows)))).cache()
    found = table.collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(set(sizes.tolist()))
    for r in found:
        limit = r["n_tokens"]
        kept = np.minimum(sizes, limit).sum()
        assert (r["n_docs"], r["docs_longer"], r["total_docs"]) == ((sizes == limit).sum(), (sizes > limit).sum(), len(sizes))
        assert (r["total_tokens"], r["kept_tokens"], r["cut_tokens"]) == (sizes.sum(), kept, sizes.sum() - kept)
        assert r["quantile"] == pytest.approx((sizes <= limit).mean())
    for r in lengths.at_limits(table, [0, 1, 77, 4096, 10**7]).collect():
        assert (r["docs_longer"], r["kept_tokens"]) == ((sizes > r["context_limit"]).sum(), np.minimum(sizes, r["context_limit"]).sum())
    for r in lengths.quantile_lengths(table, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == min(n for n in sizes if (sizes <= n).mean() >= r["share"])
    assert lengths.length_table(lengths.histogram(lengths.encoded_lengths(documents(spark, [])))).collect() == []


def test_packing_places_every_token_once(spark, tokenizer):
    rows = texts()
    found = packing.pack(documents(spark, rows), sizes=(128, 512, 2048)).collect()
    placed = Counter()
    for r in found:
        placed[(r["doc_id"], r["text_hash"], r["copy"])] += r["tokens"]
    assert sorted(((str(i), n) for (i, *_), n in placed.items())) == sorted((str(i), len(ids_of(tokenizer, t))) for i, t in rows)
    held: dict = {}
    for r in found:
        if r["sequence"] is None:
            assert r["tokens"] == 0
        else:
            held.setdefault((r["sequence"], r["size"]), []).append((r["offset"], r["tokens"]))
    assert len({s for s, _ in held}) == len(held)
    for (_, size), spans in held.items():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        used = spans[-1][0] + spans[-1][1]
        assert size == min(s for s in (128, 512, 2048) if s >= used)
    assert packing.pack(documents(spark, [])).collect() == []


def test_best_fit_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.geometric(1 / 300, 2000).clip(1, 4096).tolist()
    place, capacity = packing.best_fit(sizes, (512, 1024, 2048, 4096))
    used = np.bincount(place, weights=sizes)
    assert (used <= capacity).all()
    assert used.sum() / sum(capacity) > 0.97


def test_id_files(spark, tokenizer, tmp_path):
    rows = texts()
    folder = str(tmp_path / "ids")
    files = idfiles.write_ids(documents(spark, rows), folder)
    found = idfiles.read_ids(spark, folder, files, ids=True).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((i, (*ids_of(tokenizer, t), 1)) for i, t in rows)
    known = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert known == sorted(known) and found[0]["doc_id"] is None
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_id_file_reads_one_document_and_notices_damage(tmp_path):
    import io

    import zstandard

    stream = io.BytesIO()
    writer = idfiles.IdWriter(stream)
    lists = [np.arange(n, dtype=np.uint32) * 7 for n in (3, 70_000, 0, 5, 60_000)]
    for i, ids in enumerate(lists):
        writer.add(i * 10, ids)
    writer.close()
    raw = stream.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(x.tobytes() for x in lists)

    class Held(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = idfiles.IdReader(Held(raw))
    assert len(reader.entries) > 1
    for i, ids in enumerate(lists):
        assert reader.read(i * 10)[0].tolist() == ids.tolist()
    assert reader.read(5) == []
    reader.entries = reader.entries.copy()
    reader.entries[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)


def test_id_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert idfiles.read_ids(spark, folder, idfiles.write_ids(documents(spark, []), folder)).collect() == []


@pytest.mark.parametrize("bound", ["SET_MEMBERS", "SET_SHINGLES"])
def test_full_sets_are_bounded_in_groups_that_a_component_keeps(spark, monkeypatch, bound):
    monkeypatch.setattr(neardup, bound, 8 if bound == "SET_MEMBERS" else 80)
    spans = {1: range(0, 200), 2: range(199, 400)}
    pruned = spark.createDataFrame([(g, i, s[0]) for g, s in spans.items() for i in s], "group long, id long, head long")
    sizes = spark.createDataFrame([(i, 10) for i in range(400)], "id long, n_shingles long")
    groups: dict = {}
    for r in neardup._candidate_groups(pruned, sizes).collect():
        groups.setdefault(r["group"], set()).add(r["id"])
    assert max(map(len, groups.values())) <= 48
    # Fewer rows than blocks of the component would send, and every pair of a group still meets.
    assert sum(map(len, groups.values())) < 400 * 50
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert all((a, b) in met for s in spans.values() for a in s for b in s)


def thue_morse(letters: str) -> str:
    return "".join(letters[n.bit_count() % 2] for n in range(1024))


def test_long_words_alike_to_a_polynomial_are_told_apart(spark):
    one, other = thue_morse("ab"), thue_morse("ba")
    copies = documents(spark, [(1, f"{one} same words here"), (2, f"{other} same words here"), (3, one), (4, other)])
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(copies, 4).collect()} == {i: i for i in range(1, 5)}
    passages = documents(spark, [(1, " ".join([one, *map(str, range(60))])), (2, " ".join([other, *map(str, range(49))]))])
    assert {r["n_removed"] for r in substring.remove_repeats(passages, 50).collect()} == {0}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    """The SQL of a query gives its rows on whole tables."""
    found = queries.QUERIES[name](spark, SF)
    cursor = duck(SF).execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
