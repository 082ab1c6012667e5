"""Language of a text from its bytes: a small convolutional network trained in numpy.

Text is cut into windows of a fixed number of bytes. Filters of several widths slide over each
window, the maximum of each filter goes through a softmax layer, and the log-probabilities of all
windows of a document, weighted by their bytes, give its language. Every byte of a text is in
exactly one window.

The network is fitted on a bounded sample of labelled rows (about ``SAMPLE_PER_LANGUAGE`` documents of
each language, those with the lowest hashes of the id); that bound is the only one, prediction covers all text.

Defined cases: null text or text without a letter gives ``und`` with score 0; a text of any length
is predicted whole; a last window that is short is padded with zero bytes; repeated rows are each
predicted; with no labelled row at all every document is ``und``; extra columns are ignored; a null
id counts as held out, so it is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import bounded, filled, pieces

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_PER_LANGUAGE = 800
WINDOWS_PER_TEXT = 6
EPOCHS = 3
BATCH = 64
UNKNOWN = "und"


def text_windows(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as byte rows, with the text number and the bytes used of each."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    doc = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][doc] + number * window
    used = np.minimum(lengths[doc] - number * window, window)
    at = start[:, None] + np.arange(window)
    inside = np.arange(window) < used[:, None]
    rows = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return rows, doc, used


class ByteNet:
    """Filters over one-hot bytes, so a filter's response is a sum of table rows, one per offset."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        hidden = len(WIDTHS) * FILTERS
        self.out = rng.normal(0, hidden**-0.5, (hidden, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def packed(self) -> list[list[np.ndarray]]:
        """Tables over byte pairs: half as many rows to add up when predicting."""
        out = []
        for table in self.tables:
            width, steps = len(table), []
            for j in range(0, width - 1, 2):
                steps.append((table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, FILTERS))
            out.append([*steps, *([table[-1]] if width % 2 else [])])
        return out

    def pooled_fast(self, rows: np.ndarray, packed: list[list[np.ndarray]]) -> np.ndarray:
        single = rows.astype(np.int32)
        pair = single[:, :-1] * 256 + single[:, 1:]
        values = []
        for k, width in enumerate(WIDTHS):
            span = rows.shape[1] - width + 1
            total = None
            for j, table in enumerate(packed[k]):
                source = pair if len(table) > 256 else single
                response = table.take(source[:, 2 * j : 2 * j + span], axis=0, mode="clip")
                if total is None:
                    total = response
                else:
                    total += response
            values.append(total.max(axis=1) + self.bias[k])
        return np.maximum(np.concatenate(values, axis=1), 0)

    def pooled(self, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        values, found = [], []
        for k, width in enumerate(WIDTHS):
            span = rows.shape[1] - width + 1
            response = self.tables[k][0][rows[:, :span]]
            for j in range(1, width):
                response += self.tables[k][j][rows[:, j : j + span]]
            if places:
                at = response.argmax(axis=1)
                found.append(at)
                best = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0]
            else:
                best = response.max(axis=1)
            values.append(best + self.bias[k])
        return np.maximum(np.concatenate(values, axis=1), 0), found

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> ByteNet:
        """Adam on the softmax loss; a filter only learns at the place of its maximum."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for low in range(0, len(rows), BATCH):
                pick = order[low : low + BATCH]
                hidden, places = self.pooled(rows[pick], places=True)
                wrong = np.exp(self.log_probabilities(hidden))
                wrong[np.arange(len(pick)), labels[pick]] -= 1
                wrong /= len(pick)
                back = (wrong @ self.out.T) * (hidden > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                for k, width in enumerate(WIDTHS):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        seen = np.take_along_axis(rows[pick], places[k] + j, axis=1)
                        np.add.at(grads[k][j], (seen, np.arange(FILTERS)[None, :]), part)
                grads += [back.sum(axis=0).reshape(self.bias.shape), hidden.T @ wrong, wrong.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, texts: pa.Array, packed: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and probability of each text; windows weigh by their bytes."""
        rows, doc, used = text_windows(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(rows), 256):
            part = slice(low, low + 256)
            logs = self.log_probabilities(self.pooled_fast(rows[part], packed)) * used[part, None]
            for j in range(len(self.languages)):
                sums[:, j] += np.bincount(doc[part], weights=logs[:, j], minlength=len(texts))
        total = np.maximum(np.bincount(doc, weights=used, minlength=len(texts)), 1)[:, None]
        means = sums / total
        odds = np.exp(means - means.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
        return best, odds[np.arange(len(texts)), best]


def held_out():
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteNet | None:
    """Fit on about ``per_language`` documents of each language: those whose id hashes below that share."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, min(1.0, per_language / n)).otherwise(share)
    sample = usable.where(place < share)
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)),
        lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)),
    )
    rows = sample.select("lang", F.explode(spans).alias("span")).orderBy("lang", "span").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:  # no id hashed below the share of a tiny table
        return train(docs, per_language * 4) if per_language < max(counts.values()) * 4 else None
    texts = filled(rows.column("span"))
    windows, doc, used = text_windows(texts)
    # A short last window is left out, but not the only window of a short text.
    full = (used > WINDOW // 4) | np.append(True, doc[1:] != doc[:-1])
    codes = {name: i for i, name in enumerate(languages)}
    labels = np.array([codes[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
    return ByteNet(languages).fit(windows[full], labels[doc[full]])


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score``, which replace columns of those names."""
    docs = bounded(docs).drop("lang_pred", "lang_score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    names = np.array(net.languages, dtype=object)
    at = docs.columns.index("text")
    letters = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = net.packed()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                best, score = net.predict(part.column(at), packed)
                known = np.asarray(part.column(part.num_columns - 1).to_numpy(zero_copy_only=False), dtype=bool)
                arrays = [*part.columns[:-1], pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "lang_pred", "lang_score"])

    plain = docs.select(*docs.columns).schema
    schema = type(plain)([f for f in plain.fields]).add("lang_pred", "string").add("lang_score", "double")
    return letters.mapInArrow(run, schema)
