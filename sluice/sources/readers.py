"""Readers with explicit schemas and writers. Every reader numbers its rows in file order where the file is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEGS = "txid string, wallet string, role string, amount double, timestamp timestamp_ntz, fee double, script_type string"
RELAY = "txid string, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int"
TRANSFERS = "sender_id string, receiver_id string, amount double, timestamp timestamp_ntz, sender_ip string, receiver_ip string, sender_phone string, sender_city string, case_id string, transfer_type string"
TRUTH = "array<struct<entity_id:string,entity_type:string,is_illicit:boolean,wallets:array<string>,coinjoin_txids:array<string>>>"
#: Columns that give the answer away; a feature list that holds one is refused.
LEAKING = ("F2230", "F3912")
TARGET = "F3924"


def _csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def _numbered(df: DataFrame) -> DataFrame:
    """``seq`` grows with the place in the file: ids of Spark's partitions, which follow the file's splits in order."""
    return df.withColumn("seq", F.monotonically_increasing_id()).withColumn("t", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)"))


def legs(spark: SparkSession, path: str) -> DataFrame:
    df = _numbered(_csv(spark, path, LEGS))
    return df.withColumn("role", F.when(F.col("role") == "input", "input").otherwise("output")).withColumn("fee", F.coalesce("fee", F.lit(0.0)))


def relay(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(_csv(spark, path, RELAY))


def transfers(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(_csv(spark, path, TRANSFERS)).withColumn("transfer_type", F.coalesce("transfer_type", F.lit("DIGITAL")))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row for each wallet of each entity; entities without wallets have none."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TRUTH)).alias("e"))
    return rows.select("e.entity_id", "e.entity_type", "e.is_illicit", F.explode("e.wallets").alias("wallet"))


def coinjoin_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("txid"))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    whole = F.regexp_extract(ip, r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$", 0)
    parts = F.split(whole, r"\.")
    number = sum((F.get(parts, i).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, 0).try_cast("long") * 256**3)
    return F.when(whole != "", number)


def geo_country(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, "start_ip string, end_ip string, country string", header=False)
    return df.select(ip_number(F.col("start_ip")).alias("start_int"), ip_number(F.col("end_ip")).alias("end_int"), "country").where("start_int IS NOT NULL")


def geo_asn(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, "start_ip string, end_ip string, asn string, asn_org string", header=False)
    return df.select(ip_number(F.col("start_ip")).alias("start_int"), ip_number(F.col("end_ip")).alias("end_int"), "asn", "asn_org").where("start_int IS NOT NULL")


def elliptic(spark: SparkSession, features: str, classes: str, n_features: int) -> DataFrame:
    """Headerless features beside their classes; transactions without a class keep a null one."""
    schema = "txId string, time_step int, " + ", ".join(f"f_{i} double" for i in range(n_features))
    return _csv(spark, features, schema, header=False).join(_csv(spark, classes, "txId string, class string"), "txId", "left")


def feature_list(spark: SparkSession, path: str) -> list[str]:
    names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
    if bad := sorted(set(names) & set(LEAKING)):
        raise ValueError(f"leaking columns in the feature list: {bad}")
    return names


def wide_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The account id (the first column), the named features and the target; Spark parses no other column. What isn't a
    number is numbered in order of first appearance."""
    raw = spark.read.csv(path, header=True)
    key = raw.columns[0]
    df = raw.select(F.col(f"`{key}`").alias("account_id"), *names, F.col(TARGET).cast("int").alias("target")).withColumn("_at", F.monotonically_increasing_id())
    kinds = df.agg(*[F.count(F.when(F.col(n).isNotNull() & F.col(n).try_cast("double").isNull(), 1)).alias(n) for n in names]).first()
    for n in names:
        if not kinds[n]:
            df = df.withColumn(n, F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)))
            continue
        seen = df.groupBy(F.coalesce(n, F.lit("nan")).alias("_v")).agg(F.min("_at").alias("_first"))
        codes = seen.select("_v", F.expr("CAST(row_number() OVER (ORDER BY _first) - 1 AS DOUBLE)").alias("_code"))
        df = df.join(codes, F.coalesce(df[n], F.lit("nan")) == codes["_v"], "left").drop("_v", n).withColumnRenamed("_code", n)
    return df.select("account_id", *names, "target")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of part files with a header each; Spark writes them in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
