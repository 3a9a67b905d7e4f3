"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table, built by the driver from the corpus' most frequent words (a bounded summary over
all documents) and broadcast: 64-bit fingerprints beside one-byte token lengths. Tier two encodes the pre-tokens that
it lacks, exactly, and keeps them in a cache of bounded size in each Python worker. Documents stay where they are
read: no pre-token is ever shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bpe_core import Merger, merger
from sluice.llm.common import Cache, frequent_words, sliced

TABLE_WORDS = 32_768
CACHE_WORDS = 300_000
LIMIT = 2048

#: Fixed value: the split pattern of the vocabulary file word_bpe_49k.json.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: str.split() takes these for white space and Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def compact_table(words: dict[str, int]) -> bytes:
    """Open addressing over a power of two of slots, at most half full: all fingerprints, then all lengths."""
    slots = 1 << max(4, (2 * len(words)).bit_length())
    keys, lengths = np.zeros(slots, "<u8"), np.zeros(slots, "u1")
    for word, n in words.items():
        key = xxhash.xxh3_64_intdigest(word.encode()) or 1
        if n < 256:
            at = key & (slots - 1)
            while keys[at] and keys[at] != key:
                at = (at + 1) & (slots - 1)
            keys[at], lengths[at] = key, n
    return keys.tobytes() + lengths.tobytes()


class TableView:
    def __init__(self, data: bytes) -> None:
        self.slots = len(data) // 9
        view = memoryview(data)
        self.keys, self.lengths = view[: 8 * self.slots].cast("Q"), view[8 * self.slots :]

    def get(self, word: bytes) -> int:
        """0: not in the table."""
        key = xxhash.xxh3_64_intdigest(word) or 1
        at = key & (self.slots - 1)
        while held := self.keys[at]:
            if held == key:
                return self.lengths[at]
            at = (at + 1) & (self.slots - 1)
        return 0


def stretch_lengths(model: Merger, frequent: TableView, size: int = CACHE_WORDS) -> Cache:
    """Token count of each stretch without white space, from its pre-tokens: table, cache, exact merge."""
    words = Cache(lambda word: frequent.get(data := word.encode()) or len(model.merge(data)), size)
    return Cache(lambda stretch: sum(map(words.__getitem__, SPLIT.findall(stretch))), size)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a final sigma). White space only separates."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def count_text(text: str, lengths: Cache, special: re.Pattern[str]) -> int:
    parts = special.split(text) if "<|" in text else [text]
    n = len(parts) - 1
    for part in parts:
        part = normalised(part)
        if _SEPARATORS.search(part):
            n += sum(map(lengths.__getitem__, SPLIT.findall(part)))
        else:
            n += sum(map(lengths.__getitem__, part.split()))
    return n


def special_pattern(model: Merger) -> re.Pattern[str]:
    return re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) or r"(?!)")


def token_counts(docs: DataFrame, path: str, text: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` (longs) instead of ``text``, one row for each row.

    Null text counts as empty (0, 0); other columns pass through unchanged, so repeated rows and null keys need no
    rule; columns named n_bytes or n_tokens are replaced. An empty table gives an empty result. ``path`` is the
    vocabulary file, readable at the same place on every executor.
    """
    spark = docs.sparkSession
    model = merger(path)
    words = frequent_words(docs, table_words, text, lower=True)
    known = {w: len(model.merge(w.encode())) for w in words if SPLIT.fullmatch(w) and normalised(w) == w}
    shared = spark.sparkContext.broadcast(compact_table(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        lengths, special = stretch_lengths(model, TableView(shared.value)), special_pattern(model)
        for batch in sliced(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [count_text(t, lengths, special) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            rest = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[f"c{i}" for i in range(len(rest) + 2)])

    kept = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_tokens")]
    # renamed for the crossing: names that clash or hold odd characters don't matter there
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(text).cast("string").alias("text"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), f"c{len(kept)} long", f"c{len(kept) + 1} long"])
    out = inner.mapInArrow(run, schema)
    return out.toDF(*[f.name for f in kept], "n_bytes", "n_tokens")


def op10(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    out = token_counts(docs.select("doc_id", "text"), path)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
