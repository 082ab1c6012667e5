"""The thin queries over the operators of this package, with their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, every=20)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, percent=80)


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.transducer import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.lengths import encoded_lengths, histogram, length_table

    return length_table(histogram(encoded_lengths(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), size=50)


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.maxscore import top_products

    return top_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=5, scale=256, every=50)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language import held_out, identify, train

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_seekable_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.idfiles import write_and_read

    return write_and_read(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.periodic import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), planted=True)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.simhash import near_by_simhash

    return near_by_simhash(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, bits=4)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.aligned import alignment_table

    return alignment_table(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Runner] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_transducer_bpe": op3_transducer_bpe,
    "op4_token_length_histogram": op4_token_length_histogram,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_maxscore_top_k": op6_maxscore_top_k,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_seekable_id_files": op10_seekable_id_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_WORDS = r"[^\x20\x09-\x0D]+"

_TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.terms, c.terms) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# Full sets joined on every shingle, then everything reachable over the links.
_NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS shingles FROM words),
marked AS (SELECT doc_id, shingles, CASE WHEN len(shingles) > 0 THEN min(doc_id) OVER (PARTITION BY shingles) ELSE doc_id END AS head FROM sets),
heads AS (SELECT doc_id AS id, len(shingles) AS n, unnest(shingles) AS shingle FROM marked WHERE doc_id = head),
links AS (
  SELECT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.shingle = b.shingle AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, other) AS (
  SELECT DISTINCT a, a FROM edges UNION SELECT r.id, e.b FROM reached r JOIN edges e ON r.other = e.a),
least AS (SELECT id, min(other) AS component FROM reached GROUP BY id)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component, head) AS component_id, doc_id = coalesce(component, head) AS kept
FROM marked LEFT JOIN least ON head = id
"""

# Every window as a string, in the document with the smallest id first.
_REPEATED_PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {{'i': i, 'words': array_to_string(w[i:i + 49], ' ')}}), recursive := true)
  FROM d WHERE len(w) >= 50),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) < doc_id AS seen FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM judged WHERE seen),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# The tables hold one row for each id, as these twins suppose.
SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _NEAR_DUPLICATES,
    "op5_substring_dedup": _REPEATED_PASSAGES,
    "op6_maxscore_top_k": _TOP_PRODUCTS,
}
