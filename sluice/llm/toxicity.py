"""Toxicity by a convolutional text classifier, trained in numpy on a bounded sample of labelled rows.

A word's embedding is the sum of two hashed embeddings, of the word and of its first letters, which inflected forms
share. Filters of several widths run over the words, the maximum over the whole text is taken of each, and a linear layer
gives a logit. Thresholds are calibrated by language, which is told from the text alone; a score of 0.5 is the
threshold of the text's language. A text's words, whatever their number, are all read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Cache, sliced

ROWS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 4
EPOCHS = 5
#: Spread of the first embeddings: small, so that words not met in training say next to nothing.
INITIAL = 0.05
#: Every fourth row of the sample teaches thresholds instead of weights.
CALIBRATION = 4
BATCH = 32
RATE = 0.02
#: The bound of the fit: so many labelled rows of either label, those with the smallest hashes.
SAMPLE = 4000
#: Places of a text whose responses are held at a time.
PLACES = 50_000
SEED = 11
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")

#: Common words by which a text's language is told; a text without any is of the last, unnamed kind.
LANGUAGES = {
    "en": {"the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "by", "are", "this", "from"},
    "de": {"der", "die", "und", "den", "das", "nicht", "ist", "ein", "eine", "zu", "mit", "auf", "von", "dem"},
    "fr": {"le", "la", "les", "des", "et", "est", "dans", "qui", "une", "du", "pour", "sur", "avec", "pas"},
    "es": {"el", "los", "las", "del", "que", "una", "por", "con", "para", "se", "su", "lo", "como", "y"},
}
KINDS = (*LANGUAGES, "")


def word_rows(word: str) -> int:
    """Both embedding rows of a word, packed: that of the word and that of its beginning."""
    return xxhash.xxh3_64_intdigest(word.encode(), 1) % ROWS << 32 | xxhash.xxh3_64_intdigest(word[:STEM].encode(), 2) % ROWS


def language(words: list[str]) -> int:
    """Index into KINDS: the language with most common words, the earlier on a tie."""
    counts = [0] * len(LANGUAGES)
    for i, common in enumerate(LANGUAGES.values()):
        counts[i] = sum(map(common.__contains__, words))
    best = max(range(len(counts)), key=counts.__getitem__)
    return best if counts[best] else len(LANGUAGES)


@dataclass
class Model:
    """``tables``: for each width and place in the filter, the response of each embedding row."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]


def pooled(word: np.ndarray, stem: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """The maxima of all filters over a text; 0 for the filters that it is too short for. Long texts go in blocks."""
    parts = []
    for table in tables:
        width, best = len(table), None
        for lo in range(0, max(0, len(word) - width + 1), PLACES):
            hi = min(lo + PLACES, len(word) - width + 1)
            sums = sum(table[k][word[lo + k : hi + k]] + table[k][stem[lo + k : hi + k]] for k in range(width))
            top = sums.max(axis=0)
            best = top if best is None else np.maximum(best, top)
        parts.append(np.zeros(table[0].shape[1], np.float32) if best is None else best)
    return np.concatenate(parts)


def strongest(word: np.ndarray, stem: np.ndarray, embedding: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter over a text and its first place; 0 and -1 for those that the text is too short for."""
    values, places = np.zeros(len(filters) * FILTERS), np.full(len(filters) * FILTERS, -1)
    for lo in range(0, len(word), PLACES):
        some = slice(lo, lo + PLACES + len(filters) - 1)
        e = embedding[word[some]] + embedding[stem[some]]
        for i, f in enumerate(filters):
            w = len(f)
            n = min(PLACES, len(word) - w + 1 - lo)
            if n > 0:
                got = sum(e[k : n + k] @ f[k] for k in range(w))
                at = got.argmax(axis=0)
                top = got[at, np.arange(FILTERS)]
                span = slice(i * FILTERS, (i + 1) * FILTERS)
                more = (places[span] < 0) | (top > values[span])
                values[span], places[span] = np.where(more, top, values[span]), np.where(more, lo + at, places[span])
    return values, places


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Adam on the logistic loss; the same rows in the same order give the same model. With rows of one label only,
    every score is below (or above) the threshold."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, INITIAL, (ROWS, DIM)), *[rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, len(WIDTHS) * FILTERS), np.zeros(1)]
    p = [x.astype(np.float64) for x in p]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    ids, kinds, rows_of = [], [], Cache(word_rows, CACHE_WORDS)
    for text in texts:
        words = _WORD.findall(text.lower())
        kinds.append(language(words))
        packed = np.fromiter(map(rows_of.__getitem__, words), np.int64, len(words))
        ids.append(((packed >> 32).astype(np.uint16), (packed & 0xFFFFFFFF).astype(np.uint16)))
    y = np.array(labels, float)
    apart = np.arange(len(ids)) % CALIBRATION == 0
    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(~apart))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            grads = [None, *[np.zeros_like(x) for x in p[1:]]]
            touched: dict[int, np.ndarray] = {}
            for r in rows:
                a, b = ids[r]
                values, places = strongest(a, b, p[0], p[1 : 1 + len(WIDTHS)])
                z = np.maximum(values + p[-3], 0)
                delta = (1 / (1 + np.exp(-np.clip(z @ p[-2] + p[-1][0], -50, 50))) - y[r]) / len(rows)
                grads[-1] += delta
                grads[-2] += delta * z
                back = delta * p[-2] * (z > 0)
                grads[-3] += back
                for f in np.flatnonzero(places >= 0):
                    i, g = divmod(f, FILTERS)
                    for k in range(WIDTHS[i]):
                        at = places[f] + k
                        grads[1 + i][k, :, g] += back[f] * (p[0][a[at]] + p[0][b[at]])
                        pull = back[f] * p[1 + i][k, :, g]
                        for row in (int(a[at]), int(b[at])):
                            touched[row] = touched[row] + pull if row in touched else pull
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            if touched:
                where, pull = np.array(list(touched)), np.array(list(touched.values()))
                first[0][where] = 0.9 * first[0][where] + 0.1 * pull
                second[0][where] = 0.999 * second[0][where] + 0.001 * pull**2
                p[0][where] -= rate * first[0][where] / (np.sqrt(second[0][where]) + 1e-8)
            for i in range(1, len(p)):
                first[i] = 0.9 * first[i] + 0.1 * grads[i]
                second[i] = 0.999 * second[i] + 0.001 * grads[i] ** 2
                p[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    model = Model(p[0].astype(np.float32), [f.astype(np.float32) for f in p[1 : 1 + len(WIDTHS)]], p[-3], p[-2], np.zeros(len(KINDS)))
    tables = model.tables()
    logits = np.array([np.maximum(pooled(a, b, tables) + model.bias, 0) @ model.out for a, b in ids]) if ids else np.zeros(0)
    model.shift = -calibrated(logits[apart], y[apart], np.array(kinds, int)[apart], -p[-1][0])
    return model


def calibrated(logits: np.ndarray, y: np.ndarray, kinds: np.ndarray, neutral: float) -> np.ndarray:
    """The threshold of each language: the logit nearest to that of all rows at which at most one row more than need
    be is on the wrong side, a little inside its gap; for all rows likewise, nearest to ``neutral``. A language with few rows of either label takes that of all rows."""

    def nearest(z: np.ndarray, t: np.ndarray, to: float) -> float:
        order = np.argsort(z, kind="stable")
        z, t = z[order], t[order]
        wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([[0], np.cumsum((1 - t)[::-1])])[::-1]
        good = np.flatnonzero(wrong <= wrong.min() + 1)
        edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
        low, high = edges[good], edges[good + 1]
        room = np.minimum(0.5, (high - low) / 4)
        points = np.clip(to, low + room, high - room)
        return float(points[np.abs(points - to).argmin()])

    if not len(logits):
        return np.full(len(KINDS), neutral)
    out = np.full(len(KINDS), nearest(logits, y, neutral))
    for k in range(len(KINDS)):
        own = kinds == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= 20:
            out[k] = nearest(logits[own], y[own], out[-1])
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: the CRC-32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``sample`` rows of either label, with their whole texts, in the order of their ids' hashes. The ids are chosen from the labels
    alone, so that only their texts are looked up, by a broadcast of at most twice ``sample`` ids."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("_id"))
    picked = [known.where(F.col("toxic") == t).orderBy("h", "_id").limit(sample) for t in (1, 0)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(ids, F.col("doc_id") == F.col("_id"))
    rows = found.select("h", "doc_id", "toxic", "text")
    rows = rows.dropDuplicates(["doc_id"]).orderBy("h", "doc_id").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted in place of ``text``, one row for each row.

    Null text counts as empty; a text without words gets the score of no evidence, the model's bias. Labels only teach: labels other than 0
    and 1, of null ids or of held-out rows are ignored, and of several labels of one id the greater counts. Without any label every score is 0.5 or
    below it by no evidence. Columns named score or predicted are replaced, others pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(*training_rows(docs.select("doc_id", F.col(text).alias("text")), labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        rows_of = Cache(word_rows, CACHE_WORDS)

        def score(value: str) -> float:
            words = _WORD.findall(value.lower())
            packed = np.fromiter(map(rows_of.__getitem__, words), np.int64, len(words))
            z = np.maximum(pooled(packed >> 32, packed & 0xFFFFFFFF, tables) + model.bias, 0) @ model.out
            return float(1 / (1 + np.exp(-np.clip(z + model.shift[language(words)], -30, 30))))

        for batch in sliced(batches):
            scores = [score(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    kept = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(text).cast("string").alias("text"))
    kinds = [*(f.dataType.simpleString() for f in kept), "double", "int"]
    return inner.mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds))).toDF(*[f.name for f in kept], "score", "predicted")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
