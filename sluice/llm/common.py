"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.joins import join_back
from sluice.session import drop, release, shared_file, written

__all__ = ["drop", "release", "shared_file", "written"]

#: Words are runs of anything but ASCII white space, as a Java regular expression.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` reduced to (uid, key, text, *keep): uid is a non-null long, unique per row and ordered like the key. ``keep``
    may not hold these names; callers that carry any columns along rename them first (``renamed``).

    Where the key is unique and not null it is the uid itself; a narrow count over the key column decides.
    Else distinct (key, text digest) pairs are numbered in key order (nulls first) by a range sort, and equal
    rows share one uid.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *keep)
    odd = base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("key").isNull() | (F.col("n") > 1)).limit(1)
    if odd.isEmpty():
        return base.select(F.col("key").alias("uid"), "key", "text", *keep)
    base = base.withColumn("digest", F.sha2("text", 256))
    order = [F.col("key").asc_nulls_first(), F.col("digest")]
    names = base.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("c")).repartitionByRange(*order).sortWithinPartitions(*order)
    names = written(names.select(F.coalesce("key", F.lit(0)).alias("_k"), F.col("key").isNull().alias("_n"), "digest", F.monotonically_increasing_id().alias("uid"), "c"))
    total = names.agg(F.sum("c")).first()[0] or 0
    base = base.select(F.coalesce("key", F.lit(0)).alias("_k"), F.col("key").isNull().alias("_n"), "*")
    return join_back(base, names, ["_k", "_n", "digest"], total).select("uid", "key", "text", *keep)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ..., which clash with nothing that is added to them, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


#: Lists of ids are broadcast, as a filter, up to so many; beyond, a shuffle does the same.
BROADCAST_IDS = 2_000_000


def with_ids(docs: DataFrame, ids: DataFrame, column: str, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ``column`` is (how "left_semi") or isn't ("left_anti") among the ``ids``, a written table."""
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, column, how)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is worked out for one at a time is small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def frequent_words(docs: DataFrame, k: int, text: str = "text", lower: bool = False, per_task: int = 8192, cap: int = 65_536) -> list[str]:
    """The ``k`` most frequent words over all documents, stripped of punctuation, most frequent first.

    Every task counts its own words in a counter of at most ``cap`` entries (words seen once go first when it is
    full) and hands on its ``per_task`` commonest, so what is shuffled is a bounded summary per task and what the
    driver gets is ``k`` rows. The order of equally frequent words is by code point. The list only steers caches:
    no result depends on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    seen.update((value.lower() if lower else value).split())
                    if len(seen) > cap:
                        seen = Counter({w: n for w, n in seen.items() if n > 1})
                        if len(seen) > cap // 2:
                            seen = Counter(dict(seen.most_common(cap // 4)))
        merged: Counter[str] = Counter()
        for word, n in seen.most_common(2 * per_task):
            word = word.strip("\"'()[].,;:!?")
            if 0 < len(word) <= 32 and word.isalpha():
                merged[word] += n
        top = merged.most_common(per_task)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counts = docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(k).collect()
    return [r["word"] for r in rows]


class Cache(dict):
    """A dict that fills itself through ``make`` and holds at most two generations of ``size`` entries.

    A full generation becomes the old one and the old one goes, so entries in use survive and memory is bounded. Keys of more
    than LONGEST characters, whole paragraphs without a blank perhaps, are worked out each time and not kept.
    """

    LONGEST = 64

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
