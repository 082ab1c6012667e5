"""Text expressions: tokens, synonyms, instruction-like text, number grounding, question rules."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WORD, PART = "[a-z0-9_]{3,}", "[a-z0-9]{3,}"
UNICODE_WORD, UNICODE_PART = r"[\p{L}\p{N}_]{3,}", r"[\p{L}\p{N}]{3,}"
MIN_TOKEN = 3
INJECTION_PATTERN = (
    r"(?i)ignore (?:all |any |the )?(?:previous|above|prior) instructions|"
    r"reveal (?:the )?(?:system prompt|api key|secret|credentials)|"
    r"you are now|system prompt|developer message|disregard (?:all |the )?instructions"
)
SECRET_PATTERN = r"(?i)(system prompt|api key|secret|credential)"
NUMBER_PATTERN = r"(?<![A-Za-z])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
STOP_WORDS = (
    "a", "an", "and", "are", "for", "is", "of", "the", "to", "was", "were", "what", "why", "how",
    "would", "do", "does", "can", "could", "about", "that", "this", "with", "in", "on", "me", "my", "please",
)
SYNONYMS = {
    "leaving": ("churn", "attrition", "cancel", "cancellation", "retention", "leave"),
    "leave": ("churn", "attrition", "cancel", "retention"),
    "customers": ("customer", "subscriber", "account"),
    "discount": ("discount", "offer", "price", "pricing", "experiment", "treatment"),
    "probability": ("probability", "risk", "predict", "prediction", "churn"),
    "prob": ("probability", "risk", "predict", "prediction"),
}
BUSINESS_TERMS = (
    "business", "customer", "customers", "churn", "attrition", "retention", "sales", "revenue",
    "discount", "offer", "experiment", "prediction", "probability", "risk", "dataset", "data",
    "model", "feature", "target", "insight", "analysis", "recommendation", "score", "results",
)
ODDS_WORDS = ("probability", "prob", "odds", "likely", "likelihood")
ODDS_SUBJECTS = ("churn", "customer", "risk", "probability", "customer_id", "predict")
DISCOUNT_WORDS = ("discount", "coupon", "offer", "price")


def words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column, unicode_words: bool = False) -> Column:
    """Distinct lower-case words over two characters, with the parts of joined_words added.

    The patterns take the length limit, so no word is looked at one by one.
    """
    if unicode_words:
        plain, word, part = F.lower(text), UNICODE_WORD, UNICODE_PART
    else:
        # Only plain letters can be part of a word, so only they need lowering.
        plain, word, part = F.translate(text, string.ascii_uppercase, string.ascii_lowercase), WORD, PART
    whole = F.regexp_extract_all(plain, F.lit(word), F.lit(0))
    parts = F.regexp_extract_all(plain, F.lit(part), F.lit(0))
    joined = F.contains(plain, F.lit("_"))
    return F.array_distinct(F.when(joined, F.concat(whole, parts)).otherwise(whole))


def query_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), words(STOP_WORDS))


def expand_synonyms(query: Column) -> Column:
    """The words with their synonyms, distinct."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), words(v))])
    extra = F.flatten(F.transform(query, lambda w: F.coalesce(table[w], F.array().cast("array<string>"))))
    return F.array_union(query, extra)


def is_instruction_like(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(INJECTION_PATTERN)


def asks_for_secrets(text: Column) -> Column:
    return is_instruction_like(text) | F.coalesce(text, F.lit("")).rlike(SECRET_PATTERN)


def is_probability_question(text: Column) -> Column:
    found = tokens(text)
    return F.arrays_overlap(found, words(ODDS_WORDS)) & F.arrays_overlap(found, words(ODDS_SUBJECTS))


def is_discount_question(text: Column) -> Column:
    return F.arrays_overlap(tokens(text), words(DISCOUNT_WORDS))


def is_off_topic(text: Column, vocabulary: Column) -> Column:
    """No business word and no word of the run's own vocabulary (an array of tokens)."""
    query = query_tokens(text)
    known = F.array_except(F.coalesce(vocabulary, F.array().cast("array<string>")), words(STOP_WORDS))
    return ~F.arrays_overlap(query, words(BUSINESS_TERMS)) & ~F.arrays_overlap(query, known)


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_PATTERN), F.lit(0))


def _shown(value: Column, digits: int, suffix: str = "") -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(value, digits)), F.lit(suffix))


def _spellings(raw: Column) -> Column:
    """The number as written, rounded to 0-2 digits, and as a percentage when it is a share."""
    is_pct = F.endswith(raw, F.lit("%"))
    value = F.regexp_replace(raw, "[,%]", "").try_cast("double")
    plain = F.array(*[_shown(value, d) for d in (0, 1, 2)])
    pct = F.array(*[_shown(value, d, "%") for d in (0, 1)])
    share = F.array(
        *[_shown(value * 100, d, "%") for d in (0, 1, 2)],
        F.bround(value, 2).cast("string"),
        F.bround(value, 3).cast("string"),
    )
    nothing = F.array().cast("array<string>")
    is_share = ~is_pct & (F.abs(value) > 0) & (F.abs(value) <= 1)
    return F.concat(F.array(raw), F.when(is_pct, pct).otherwise(plain), F.when(is_share, share).otherwise(nothing))


def numbers_grounded(answer: Column, evidence: Column) -> Column:
    """True when every number of the answer is in the evidence, a rounding of it, or 0 to 10."""
    small = F.array(*[F.lit(str(i)) for i in range(11)])
    seeds = F.array_union(numbers_in(evidence), small)
    allowed = F.flatten(F.transform(seeds, _spellings))
    return F.size(F.array_except(numbers_in(answer), allowed)) == 0
