"""From raw documents to token ids in five stages, each over all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. The
result of each is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, minhash, mixing, quality, suffixes
from sluice.llm.common import drop, renamed, table, written
from sluice.llm.queries import tokenizer

#: No SQL: the stages hash, sketch and encode. tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or score below the threshold go. Each row is judged by itself, whatever its id."""
    some, name = renamed(docs)
    named = some.select("*", F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"))
    judged = quality.quality(named, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*name.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, one with the smallest id. Rows are judged by themselves: of those that
    share an id and have different texts, or have no id, each stays or goes with its own group."""
    return minhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier in the corpus are cut out."""
    return suffixes.deduplicated(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their budgets or repeated."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the text that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), decoded="decoded")
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            done = written(done)
            drop(docs)
        docs = done
    return docs
