"""Mixing sources to target weights by hash order and distributed prefix sums.

Every document gets a hash-random key. Keys are range-sorted within each source: a key's leading bits name its range, about as
many ranges as each holds documents, so a source of any size is spread over many tasks. Sums of the ranges, summed up within each source, and
running sums within each range give every document the words that come before it; the source is cut exactly where its
budget ends, after whole epochs if the budget exceeds the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import WORD, renamed, sliced, written

#: Weights of the sources by code point, repeating; the mix's share of all words; the most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1:"
KEY_BITS = 60
#: Tables of one row per source are broadcast up to so many rows, and joined with salted copies beyond.
BROADCAST_ROWS = 100_000
SALTS = 32


def key_of(doc_id: Column) -> Column:
    """60 bits of the id's MD5; null ids hash as empty."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): each source gets words in proportion to its weight, and
    what it can't take within MOST_EPOCHS is shared again among the others by weight.

    Sources are filled in order of room per weight: a source is full if its share of what is left then exceeds its
    room, and those after the last full one share alike. One row per source passes through one task.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    out = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    out = out.withColumn("room", F.col("cap").cast("double") / F.col("w"))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double") * F.lit(SHARE)
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum("w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    out = out.withColumn("level", (total - before) / rest)
    out = out.withColumn("full", F.col("cap").cast("double") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return out.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def prefix_sums(units: DataFrame, bits: int) -> DataFrame:
    """(source, key, doc_id, size) with ``before``: the sizes of the source's rows of smaller (key, doc_id)."""
    units = units.withColumn("part", F.shiftright("key", KEY_BITS - bits))
    parts = units.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    return units.join(parts, same).select("source", "key", "doc_id", "size", (F.col("offset") + F.col("inner")).alias("before"))


def cuts(sized: DataFrame) -> DataFrame:
    """One row per source: its size, target, whole epochs, and the unit in which the last epoch ends, if one does.

    A unit is all rows of one doc_id in one source.
    """
    n = sized.count()
    bits = min(24, max(1, round(log2(max(n, 4)) / 2)))
    units = sized.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    budget = plan.select(F.col("source").alias("s"), "rest")
    met = prefix_sums(units, bits).join(budget, F.col("source").eqNullSafe(F.col("s")))
    met = met.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
    met = met.select("s", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), (F.col("rest") - F.col("before")).alias("cut_words"))
    return plan.join(met, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def with_sources(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds each source's row, of a written table: by broadcast while there are few sources, else over salted copies, so that a
    source with many documents is spread over SALTS tasks."""
    few = by_source.count() <= BROADCAST_ROWS
    by_source = by_source.withColumnRenamed("source", "_s")
    if few:
        return docs.join(F.broadcast(by_source), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    salted = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("_salt_of", F.pmod(F.col("_key"), F.lit(SALTS)))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_salt_of") == F.col("_salt"))
    return docs.join(salted, same).drop("_s", "_salt", "_salt_of")


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def identified(docs: DataFrame, doc_id: str, source: str) -> DataFrame:
    """``docs`` with what places a row: _id, _source, _key."""
    return docs.select("*", F.col(doc_id).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), key_of(F.col(doc_id)).alias("_key"))


def placed(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` (_id, _source, _key, ...) with their source's plan and whether they come before the cut (_before) or at it
    (_at_cut). ``sized``: (source, key, doc_id, size) of all rows, a written table."""
    out = with_sources(rows, written(cuts(sized)))
    none = F.lit(-(2**63))
    before = (F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.coalesce("_id", none) < F.coalesce("cut_id", none)))
    at_cut = (F.col("_key") == F.col("cut_key")) & F.col("_id").eqNullSafe(F.col("cut_id"))
    return out.withColumn("_at_cut", F.coalesce(at_cut, F.lit(False))).withColumn("_before", F.coalesce(before, F.lit(False)))


def last_words(size: Column) -> Column:
    """What the epoch that ends at the cut takes of a placed row."""
    share = F.floor(size.cast("decimal(20,0)") * F.col("cut_words").cast("decimal(18,0)") / F.col("cut_size")).cast("long")
    at_cut = F.when(size == F.col("cut_size"), F.col("cut_words")).otherwise(share)
    return F.when(F.col("_at_cut"), at_cut).when(F.col("_before"), size).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target and taken: how many of its words the mix takes, repeats counted.

    Null text has size 0; a null source is a source of its own, last in the order of weights. Rows that share a
    doc_id within a source (null ids too) are placed together: if the cut falls among them, each is taken to the same
    share, rounded down. Columns named like a result are replaced, other columns pass through. An empty table gives an empty
    result. Reruns agree: nothing but ids, sources and sizes decides. Texts are read twice: for all sizes, and for the result.
    """
    some, name = renamed(docs)
    rows = identified(some, name["doc_id"], name["source"]).withColumn("_size", words_in(F.col(name[text])))
    out = placed(rows, sizes_of(rows))
    results = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("epochs") * F.col("_size") + last_words(F.col("_size"))}
    return out.select(*[F.col(c).alias(n) for n, c in name.items() if n not in results], *[c.alias(n) for n, c in results.items()])


def sizes_of(rows: DataFrame) -> DataFrame:
    return written(rows.select(F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_id").alias("doc_id"), F.col("_size").alias("size")))


def first_words(value: str, n: int) -> str:
    """The beginning of a text up to the end of its n-th word."""
    import re

    for i, word in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", value), 1):
        if i == n:
            return value[: word.end()]
    return value if n > 0 else ""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: a document is repeated for every whole epoch, and the
    one where a source's budget ends appears once more up to the cut; its n_chars is counted anew. What the mix takes nothing of is left out."""
    some, name = renamed(docs)
    rows, text, columns = identified(some, name["doc_id"], name["source"]), name["text"], list(name.values())
    out = placed(rows, sizes_of(rows.withColumn("_size", words_in(F.col(text)))))
    copies = (F.col("epochs") + F.when(F.col("_before"), 1).otherwise(0)).cast("int")
    repeated = out.withColumn("_copies", copies).where("_copies > 0").where(F.rlike(F.coalesce(text, F.lit("")), F.lit(WORD)))
    repeated = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)
    # one unit of a source at most is cut; only its rows are counted again. If the cut takes it whole it is one more copy
    part = out.where("_at_cut").withColumn("_part", last_words(words_in(F.col(text)))).where("_part > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [first_words(t, n) for t, n in zip(batch.column(text).to_pylist(), batch.column("_part").to_pylist(), strict=True)]
            held = {c: batch.column(c) for c in columns} | {text: pa.array(texts, pa.string())}
            if "n_chars" in name:
                held[name["n_chars"]] = pa.array([len(t) for t in texts]).cast(batch.schema.field(name["n_chars"]).type)
            yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    return repeated.unionByName(part.select(*columns, "_part").mapInArrow(cut, some.schema)).toDF(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns: texts are read once, for their sizes."""
    rows = identified(docs.select("doc_id", "source", words_in(F.col("text")).alias("_size")), "doc_id", "source")
    rows = written(rows)
    out = placed(rows, rows.select(F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_id").alias("doc_id"), F.col("_size").alias("size")))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("_size") + last_words(F.col("_size"))).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {KEY_BITS // 4}) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    2 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS room FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
      - CAST(coalesce(sum(cap) OVER (ORDER BY room, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY room, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
f AS (SELECT *, CAST(cap AS DOUBLE) <= level * w AS is_full FROM l),
t AS (SELECT source, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * w END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
  CAST(b.epochs * p.size + greatest(0, least(p.size, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
