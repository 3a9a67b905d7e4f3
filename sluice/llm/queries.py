"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, chat, embeddings, licenses, minhash, mixing, quality, suffixes, token_counts, toxicity
from sluice.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op1(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op2(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op5(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op6(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op9(table(spark, sf_dir, "conversations"), tokenizer("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_embeddings": op4_embeddings,
    "op5_suffixes": op5_suffixes,
    "op6_minhash": op6_minhash,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op4_embeddings": embeddings.ORACLE, "op6_minhash": minhash.ORACLE, "op9_chat": chat.ORACLE}
