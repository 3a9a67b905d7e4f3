"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.joins import join_back
from sluice.session import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes: the component is its smallest node.

    In the large star every node's greater neighbours are linked with its smallest neighbour, in the small star its smaller ones;
    the number of rounds grows with the logarithm of the nodes. Every round is written to the shared folder. Minima
    are combined before the shuffle, so a node with very many neighbours costs one row per task, and the joins that bring them
    back broadcast the few hubs. Superseded rounds are deleted. Nodes are of any type that can be ordered. Edges with a null end are ignored; no edges give an empty table.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = join_back(both, least, ["u"], 2 * state[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        tops = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(tops, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(rest.union(tops.select("a", F.col("m").alias("b"))).distinct())
        drop(now)
        now = after
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
