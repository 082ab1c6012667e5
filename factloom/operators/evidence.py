"""Evidence for questions about stored runs: lines, retrieval, context, history, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.session import deal, materialize

# Packing limits.
PROMPT_CHARS = 16_000
MIN_OVERLAP = 2
MIN_ROOM, JOINER = 80, 4
# Stored insights, chart facts and stored tests hold text from outside.
FILTERED_PRIORITIES = (2, 3)
HISTORY_TURNS, MAX_TURN_CHARS = 8, 1000
RECENT_PREDICTIONS = 5
SMALL_QUESTION_WORDS = 200_000
# Two different words of three characters and a gap between them.
SMALLEST_MATCH = 2 * X.MIN_TOKEN + 1


def safe_evidence(evidence: DataFrame, content: str = "content") -> DataFrame:
    """Rows with text that is not instruction-like."""
    return evidence.filter((F.trim(content) != "") & ~X.is_instruction_like(F.col(content)))


def question_overlap(questions: DataFrame, evidence: DataFrame, small: int = SMALL_QUESTION_WORDS) -> DataFrame:
    """(run_id, question_id, item_id, source, content, overlap) for items sharing two words or more.

    ``questions``: run_id, question_id, question. ``evidence``: run_id, item_id,
    source, content. Words are joined by equality within a run, so the work is
    the length of the matching word lists, and the text itself is not shuffled
    until the matches are known. Up to ``small`` question words are sent to the
    items; more are joined by shuffle, without the commonest word of each question.
    """
    return _overlap(questions, safe_evidence(evidence), small)


def _overlap(questions: DataFrame, items: DataFrame, small: int = SMALL_QUESTION_WORDS) -> DataFrame:
    asked = questions.select(
        "run_id", "question_id", F.explode(X.expand_synonyms(X.query_tokens(F.col("question")))).alias("word")
    )
    held = items.select(
        "run_id", "item_id", F.explode(X.tokens(F.concat_ws(" ", "source", "content"))).alias("word")
    )
    if asked.limit(small + 1).count() <= small:
        # The words of few questions are sent to the evidence, so its words need no shuffle
        # and all matches of an item are counted where the item is.
        matched = held.join(F.broadcast(asked), ["run_id", "word"]).groupBy("run_id", "question_id", "item_id")
        overlap = matched.agg(F.count(F.lit(1)).alias("overlap"))
    else:
        overlap = _prefix_overlap(asked, held)
    overlap = overlap.filter(F.col("overlap") >= MIN_OVERLAP)
    # Repeated texts make small files, which says little about what a broadcast of them would hold.
    return overlap.join(items.select("run_id", "item_id", "source", "content").hint("merge"), ["run_id", "item_id"])


def _prefix_overlap(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(run_id, question_id, item_id, overlap) of all pairs that share a word besides the question's commonest one.

    Two shared words are one at least besides the commonest, so no pair that counts is lost. The
    commonest word is then looked up per item, under a key that no two items share.
    """
    asked, held = materialize(asked, "asked"), materialize(held, "held-words")
    common = held.groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("_items"))
    order = Window.partitionBy("run_id", "question_id").orderBy(F.desc("_items"), "word")
    # Written, so that the join with the items' words is between two plain exchanges, whose large parts can be split.
    ranked = materialize(
        asked.join(common, ["run_id", "word"])
        .withColumns({"_place": F.row_number().over(order), "_hot": F.first("word").over(order)}),
        "question-words",
    )
    rare = ranked.filter("_place > 1").select("run_id", "question_id", "word", "_hot")
    found = (
        held.join(rare, ["run_id", "word"])
        .groupBy("run_id", "question_id", "item_id", "_hot")
        .agg(F.count(F.lit(1)).alias("_shared"))
    )
    also = held.select("run_id", "item_id", F.col("word").alias("_hot"), F.lit(1).alias("_has"))
    joined = found.join(also, ["run_id", "item_id", "_hot"], "left")
    return joined.select("run_id", "question_id", "item_id", (F.col("_shared") + F.coalesce("_has", F.lit(0))).alias("overlap"))


def _packed(items: Column, cap: int) -> Column:
    """The items taken in order, each one that still fits under ``cap`` characters."""
    nothing = F.struct(F.lit(0).alias("used"), F.slice(items, 1, 0).alias("kept"))

    def take(state: Column, item: Column) -> Column:
        used = state["used"] + item["size"]
        taken = F.struct(used.alias("used"), F.concat(state["kept"], F.array(item)).alias("kept"))
        return F.when(used <= cap, taken).otherwise(state)

    return F.aggregate(items, nothing, take, lambda state: state["kept"])


def retrieve_evidence(questions: DataFrame, evidence: DataFrame, cap: int = PROMPT_CHARS) -> DataFrame:
    """Items in order of overlap, packed greedily under ``cap`` characters; what does not fit is skipped.

    Room only shrinks, so of the items of one size at most ``cap // size`` can
    be taken, and they are the first ones in order. That bounds what the
    sequential packing sees per question by about ``cap * ln(cap)`` rows,
    however many items match, without changing its result.
    """
    # Written dealt, so that the filter and the words are made on all cores whatever the files of the input.
    items = materialize(deal(safe_evidence(evidence), evidence.count()), "evidence")
    scored = _overlap(questions, items).withColumn(
        "size", F.length("source") + F.length("content")
    )
    order = Window.partitionBy("run_id", "question_id", "size").orderBy(F.desc("overlap"), "item_id")
    possible = (
        scored.filter(F.col("size") <= cap)
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= max(1, cap // SMALLEST_MATCH))
        .filter(F.col("_rn") * F.col("size") <= cap)
    )
    # Lists are bounded as said above, and walked where they are: a Python call for each question would cost more than its packing.
    item = F.struct((-F.col("overlap")).alias("last"), "item_id", "overlap", F.col("size").cast("int").alias("size"))
    listed = possible.groupBy("run_id", "question_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    spots = listed.select("run_id", "question_id", F.posexplode(_packed(F.col("_items"), cap)).alias("_at", "_item"))
    packed = spots.select("run_id", "question_id", "_item.item_id", "_item.overlap", "_item.size", (F.col("_at") + 1).alias("position"))
    texts = items.select("run_id", "item_id", "source", "content").hint("merge")
    return packed.join(texts, ["run_id", "item_id"])


def build_context(evidence: DataFrame, cap: int) -> DataFrame:
    """Evidence per run in priority order, cut with '...' and closed when under 80 characters are left.

    ``evidence``: run_id, priority, item_id, source, content. Instruction-like insights, chart facts
    and tests do not enter. Each line uses more than the joiner, so only the first ``cap // joiner``
    lines can enter.
    """
    foreign = F.col("priority").isin(*FILTERED_PRIORITIES) & X.is_instruction_like(F.col("content"))
    order = Window.partitionBy("run_id").orderBy("priority", "item_id")
    first = (
        evidence.filter((F.trim("content") != "") & ~F.coalesce(foreign, F.lit(False)))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= cap // JOINER)
        .withColumn("used", F.length("source") + F.length("content") + JOINER)
    )
    # Before the first cut line nothing is shortened, so plain running totals decide.
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_before", F.coalesce(F.sum("used").over(ahead), F.lit(0)))
    room = F.lit(cap) - F.col("_before") - F.length("source") - JOINER
    first = first.withColumn("_room", room).withColumn("_fits", F.length("content") <= F.col("_room"))
    closed = F.max(F.when((F.col("_room") < MIN_ROOM) | ~F.col("_fits"), 1).otherwise(0)).over(ahead)
    kept = first.withColumn("_closed", F.coalesce(closed, F.lit(0))).filter(
        (F.col("_closed") == 0) & (F.col("_room") >= MIN_ROOM)
    )
    shortened = F.concat(F.rtrim(F.substring(F.col("content"), F.lit(1), F.col("_room"))), F.lit("..."))
    return kept.select(
        "run_id", "position", "source",
        F.when(F.col("_fits"), F.col("content")).otherwise(shortened).alias("content"),
    )


def recent_turns(messages: DataFrame, run: str, order: Sequence[str], role: str = "role", k: int = HISTORY_TURNS) -> DataFrame:
    """The last k user and assistant turns per run with their place in time order."""
    newest = Window.partitionBy(run).orderBy(*[F.desc(c) for c in order])
    kept = (
        messages.filter(F.col(role).isin("user", "assistant"))
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= k)
    )
    oldest = Window.partitionBy(run).orderBy(*[F.asc(c) for c in order])
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_back")


def bounded_history(turns: DataFrame, run: str, room: int, content: str = "text", most: int = MAX_TURN_CHARS) -> DataFrame:
    """Newest turns first, cut at ``most`` characters each, until one does not fit the room."""
    newest = Window.partitionBy(run).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = turns.withColumn(content, F.substring(content, 1, most))
    return cut.withColumn("_used", F.sum(F.length(content)).over(newest)).filter(F.col("_used") <= room).drop("_used")


def distinct_questions(messages: DataFrame, run: str, question: str, inputs: str | None = None) -> DataFrame:
    """One row per run, case-folded question and inputs, with how often it was asked."""
    keys = [F.col(run), F.lower(F.trim(question)).alias("question_key")]
    if inputs:
        keys.append(F.coalesce(inputs, F.lit("{}")).alias("inputs_key"))
    return messages.filter(F.trim(question) != "").groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))


def question_routes(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How each question is handled: refused, off_topic, probability, discount or evidence.

    ``vocabulary``: (run_id, word), distinct words of the run's evidence. A
    question needs one shared word only, so words are matched by a semi join.
    """
    asked = questions.select(
        "run_id", "question_id", F.explode(X.query_tokens(F.col("question"))).alias("word")
    )
    known = asked.join(vocabulary, ["run_id", "word"], "left_semi").select(
        "run_id", "question_id", F.lit(True).alias("_known")
    ).distinct()
    joined = questions.join(known, ["run_id", "question_id"], "left")
    q = F.col("question")
    business = F.arrays_overlap(X.query_tokens(q), X.words(X.BUSINESS_TERMS))
    route = (
        F.when(X.asks_for_secrets(q), "refused")
        .when(~business & F.col("_known").isNull(), "off_topic")
        .when(X.is_probability_question(q), "probability")
        .when(X.is_discount_question(q), "discount")
        .otherwise("evidence")
    )
    return joined.select("run_id", "question_id", route.alias("route"))


def vocabulary(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        "run_id", F.explode(X.tokens(F.concat_ws(" ", "source", "content"))).alias("word")
    ).distinct()


def grounding_check(answers: DataFrame, answer: str, evidence: str) -> DataFrame:
    return answers.withColumn("grounded", X.numbers_grounded(F.col(answer), F.col(evidence)))
