"""Joins that bring a group's figures back to its rows, however large the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group counts as hot if it has more than this share of all rows: so there are at most so many hot groups.
HOT_GROUPS = 1000
SALTS = 64


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, count: str = "c") -> DataFrame:
    """The rows of ``rows`` whose keys are among the ``groups``, with the groups' other columns.

    ``groups`` has one row for each key, whose ``count`` says how many of ``total`` rows have it. The hot groups, at most
    HOT_GROUPS rows, are broadcast; their rows are then dealt out by a salt through the join that serves the others, in
    which they find no partner and need none. Null keys match nothing.
    """
    others = [c for c in groups.columns if c not in (*keys, count)]
    is_hot = F.col(count) * F.lit(HOT_GROUPS) > F.lit(total)
    figures = F.struct(*others, F.lit(True).alias("_found"))
    none = F.pmod(F.xxhash64(*keys), F.lit(1))  # always 0; a literal would be taken out of the join's keys
    hot = groups.where(is_hot).select(*keys, figures.alias("_hot"))
    rest = groups.where(~is_hot).select(*keys, none.alias("_salt"), figures.alias("_rest"))
    salt = F.when(F.col("_hot").isNull(), none).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    joined = marked.join(rest, [*keys, "_salt"], "left").withColumn("_figures", F.coalesce("_hot", "_rest"))
    return joined.where("_figures IS NOT NULL").select(*[F.col(c) for c in rows.columns], *[F.col(f"_figures.{c}").alias(c) for c in others])
