"""Quality rules: hashed n-gram log-likelihood ratio of a trusted-target against a raw-corpus multinomial.

DataFrame functions only. Both multinomials are counted over hashed words and word pairs: the raw one over every
document, the target over a bounded set of documents that labels call good. A document's score is the mean log ratio
of its n-grams; it is kept if the plain rules pass and the score reaches a fixed threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WORD_GAP

BUCKETS = 16_384
TRUSTED_LIMIT = 20_000
SMOOTHING = 0.5
#: Nats per n-gram. Prose of the target's kind lies around 0, whatever its length; lists, symbols and capitals lie below.
THRESHOLD = -0.1
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
_SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Array of the words; empty for null or blank text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""
    pairs = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_text`` (never null), ``_words`` and their hashes ``_h``."""
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("_words", words_of(F.col("_text")))
    return out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most ``limit`` ids that are labelled good, those with the smallest hashes: the documented bound of the fit."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS, limit: int = TRUSTED_LIMIT) -> list[float]:
    """The log ratio of each bucket. Counts of all documents are summed map-side first, so that each task shuffles at
    most one row per bucket, and the driver gets one row per bucket."""
    known = F.broadcast(trusted_ids(labels, limit).withColumn("_good", F.lit(1)))
    rows = hashed(docs.select(F.col("doc_id").alias("_key"), F.col(text)), text).join(known, F.col("_key") == F.col("_id"), "left")
    grams = rows.select("_good", F.explode(buckets_of(F.col("_h"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")).collect()
    raw, good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    if not good:
        return [0.0] * buckets
    weights = [log(raw + SMOOTHING * buckets) - log(good + SMOOTHING * buckets)] * buckets
    for r in counts:
        weights[r["b"]] += log(r["good"] + SMOOTHING) - log(r["raw"] + SMOOTHING)
    return [round(w, 6) for w in weights]


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed, score, kept.

    ``score`` is the mean log ratio of the document's hashed words and word pairs; 0 for a text without words, and
    for every text if no document is labelled good. Null text counts as empty: no words, so base_failed and not kept.
    Null or repeated doc_id only matters for whether a document counts as trusted: null never does, all rows with a
    trusted id do. Each row is judged by itself, so ties and copies get equal verdicts; an empty table gives an empty result. Columns that are
    named like a result are replaced, others pass through; names beginning with an underscore are reserved.
    """
    weights = F.split(F.lit(",".join(map(repr, fit(docs, labels, text, buckets)))), ",").cast("array<double>")
    # each step is a projection of its own: what several expressions use is worked out once
    out = hashed(docs, text).withColumn("_n", F.size("_words").cast("long"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))))
    wide = F.col("_n") >= WINDOW
    hashes = F.col("_h")
    window = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("_win", F.when(wide, window))
    out = out.withColumn("_again", F.coalesce(F.size(F.array_distinct("_win")) < F.size("_win"), F.lit(False)))
    sorted_ = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.col("_again"), sorted_))
    near = F.col("_sorted")
    twice = F.filter(near, lambda x, j: (F.get(near, j - 1)["h"] == x["h"]) | (F.get(near, j + 1)["h"] == x["h"]))
    out = out.withColumn("_at", F.when(F.col("_again"), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    at = F.col("_at")
    steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.when(F.col("_again"), F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("n_words", F.col("_n"))
    out = out.withColumn("word_chars", (F.char_length("_text") - F.regexp_count("_text", F.lit(_SPACE))).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))
    total = F.aggregate(buckets_of(F.col("_h"), buckets), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    out = out.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0)))
    # the row number is always true here; as it isn't deterministic, a filter on ``kept`` stays above these projections
    # instead of being rewritten over the text with all steps inlined
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.monotonically_increasing_id() >= 0))
    return out.drop("_text", "_words", "_h", "_n", "_lines", "_win", "_again", "_sorted", "_at")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
