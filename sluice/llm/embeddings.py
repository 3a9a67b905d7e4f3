"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors are one class. Trees are fitted on a bounded sample: each node splits its vectors at the median of a random
projection, and vectors near the median go to both sides: a share of them, and at least those within half the spread
that projections give a pair at the threshold, so that a tight group stays together and ends up whole in one leaf. Leaves that hold
many of all vectors are split again, on samples of their own. All vectors are dealt to their leaves in every tree; within
a leaf all are compared by cosine in double precision, in blocks. A pair that shares several leaves is counted in the
first, which the vectors' leaf lists tell, so no pair is ever written: a leaf gives counts and a local component per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop, written
from sluice.operators.components import components
from sluice.operators.joins import join_back

THRESHOLD = 0.9
TREES = 6
LEAF = 512
SPILL = 0.07
#: The bound of the fit: so many vectors, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Leaves beyond MOST vectors are split again, on about LEAF_SAMPLE of their own; no leaf of a sample is smaller than SMALLEST.
MOST = 2048
LEAF_SAMPLE = 4096
SMALLEST = 16
#: The bound of the broadcast forest, 24 bytes a node. Beyond it leaves aren't split further, only dealt out in chunks.
MOST_NODES = 8_000_000
BLOCK = 1024
SEED = 20


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; scaled first so that no square under- or overflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _child(key: int, side: int) -> int:
    """The key of a node's left (1) or right (2) child."""
    x = (key * 2 + side) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return (x ^ x >> 31) >> 1


def _root(dim: int, tree: int) -> int:
    return _child(SEED << 40 | dim << 8 | tree, 1)


@lru_cache(20_000)
def _plane(key: int, dim: int) -> np.ndarray:
    """A node's projection, a random unit vector that follows from its key."""
    plane = np.random.default_rng(key).standard_normal(dim)
    return plane / np.sqrt(plane @ plane)


def grow(x: np.ndarray, key: int, leaf: int, spill: float, margin: float) -> list[tuple[int, float, float]]:
    """(key, low, high) of the inner nodes of a tree over ``x`` below the node ``key``: what projects to at most high goes
    left, to at least low right. Leaves hold at most ``leaf`` rows, or rows that no plane tells apart."""
    nodes, open_ = [], [(key, np.arange(len(x)), 0)]
    while open_:
        key, rows, depth = open_.pop()
        if len(rows) <= leaf or depth >= 40:
            continue
        at = x[rows] @ _plane(key, x.shape[1])
        low, middle, high = np.quantile(at, [0.5 - spill, 0.5, 0.5 + spill])
        low, high = min(low, middle - margin), max(high, middle + margin)
        left, right = rows[at <= high], rows[at >= low]
        if max(len(left), len(right)) > 0.9 * len(rows):
            continue  # nearly all would go both ways: a tight group
        nodes.append((key, float(low), float(high)))
        open_ += [(_child(key, 1), left, depth + 1), (_child(key, 2), right, depth + 1)]
    return nodes


class Forest:
    """The inner nodes of all trees in arrays sorted by key, 24 bytes each; a key that isn't among them is a leaf's."""

    def __init__(self, trees: int, nodes: list[tuple[int, float, float]]) -> None:
        nodes = sorted(nodes)
        self.trees = trees
        self.keys = np.array([n[0] for n in nodes], np.int64)
        self.low, self.high = (np.array([n[i] for n in nodes], float) for i in (1, 2))

    def grafted(self, more: list[tuple[int, float, float]]) -> Forest:
        return Forest(self.trees, [*zip(self.keys.tolist(), self.low.tolist(), self.high.tolist(), strict=True), *more])

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows in it) of every tree; a leaf is named by its key."""
        dim = x.shape[1]
        open_ = [(_root(dim, t), np.arange(len(x))) for t in range(self.trees)]
        while open_:
            key, rows = open_.pop()
            if not len(rows):
                continue
            i = int(np.searchsorted(self.keys, key))
            if i == len(self.keys) or self.keys[i] != key:
                yield key, rows
                continue
            at = x[rows] @ _plane(key, dim)
            open_ += [(_child(key, 1), rows[at <= self.high[i]]), (_child(key, 2), rows[at >= self.low[i]])]


def margin_of(threshold: float, dim: int) -> float:
    """Half the spread that projections give a pair at the threshold."""
    return 0.5 * np.sqrt(2 * (1 - threshold) / dim)


def fit_forest(sample: list[np.ndarray], n: int, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> Forest:
    """Trees for each dimension of the sample. ``n``: how many vectors there are in all; leaves of the sample are as much
    smaller as the sample is."""
    nodes = []
    for dim in sorted({len(v) for v in sample}):
        x = unit_rows(np.stack([v for v in sample if len(v) == dim]))
        small = max(SMALLEST, leaf * len(sample) // max(n, len(sample)))
        for t in range(trees):
            nodes += grow(x, _root(dim, t), small, spill, margin_of(threshold, dim))
    return Forest(trees, nodes)


def leaf_links(x: np.ndarray, ids: np.ndarray, n: np.ndarray, earlier: np.ndarray, threshold: float, chunk: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a leaf: how many vectors it links with (a class counts with its ``n`` members) that no
    earlier leaf has counted, and the smallest id that it is connected to within the leaf. ``earlier``: bit rows of
    the earlier leaves of each vector. With ``chunk``, only pairs of different chunks are compared."""
    m = len(x)
    links, linked = np.zeros(m, np.int64), []
    for i in range(0, m, BLOCK):
        near = x[i : i + BLOCK] @ x.T >= threshold
        near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        if chunk is not None:
            near &= chunk[i : i + BLOCK, None] != chunk
        linked.append(np.packbits(near, axis=1))
        if earlier.shape[1]:
            near &= ~(earlier[i : i + BLOCK] @ earlier.T > 0)
        links[i : i + BLOCK] = near @ n
    label = np.arange(m)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = label
    while True:
        new = rank.copy()
        for b, packed in enumerate(linked):
            rows = slice(b * BLOCK, b * BLOCK + len(packed))
            for lo in range(0, len(packed), 64):
                near = np.unpackbits(packed[lo : lo + 64], axis=1, count=m).astype(bool)
                at = np.arange(rows.start + lo, rows.start + lo + len(near))
                new[at] = np.minimum(rank[at], np.where(near, rank, m).min(axis=1, initial=m))
        new = np.minimum(new, new[order[new]])
        if (new == rank).all():
            return links, ids[order[rank]]
        rank = new


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as given, their unit vectors) for each dimension."""
    flat = batch.column("v")
    ends = flat.offsets.to_numpy()
    sizes, starts, values = np.diff(ends), ends[:-1], flat.values.to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        raw = values[starts[at][:, None] + np.arange(dim)]
        yield at, raw, unit_rows(raw)


def _drawn(ids: np.ndarray, leaf: int) -> np.ndarray:
    """A number in [0, 1) for each id, another one for each leaf."""
    x = (ids.astype(np.uint64) ^ np.uint64(leaf)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2**53


def large_leaves(classes: DataFrame, forest: Broadcast, most: int) -> dict[int, int]:
    """How many vectors each leaf of more than ``most`` has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(leaf, len(rows)) for _, _, x in _vectors(batch) for leaf, rows in forest.value.leaves(x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["leaf", "c"])

    rows = classes.select("v").mapInArrow(count, "leaf long, c long").groupBy("leaf").agg(F.sum("c").alias("c"))
    return {r["leaf"]: r["c"] for r in rows.where(F.col("c") > most).collect()}


def subtrees(classes: DataFrame, forest: Broadcast, large: dict[int, int], threshold: float, leaf: int, spill: float) -> list[tuple[int, float, float]]:
    """Inner nodes below large leaves, each leaf's tree fitted in a task of its own on at most about LEAF_SAMPLE of its vectors."""
    sizes = classes.sparkSession.sparkContext.broadcast(large)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("id").to_numpy(), []
            for at, _, x in _vectors(batch):
                for name, rows in forest.value.leaves(x):
                    if c := sizes.value.get(name):
                        found += [(name, x[r].tobytes()) for r in rows[_drawn(ids[at[rows]], name) * c < LEAF_SAMPLE]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["leaf", "v"])

    def fit(group: pa.Table) -> pa.Table:
        name = group.column("leaf")[0].as_py()
        x = np.stack([np.frombuffer(v) for v in group.column("v").to_pylist()])
        small = max(SMALLEST, leaf * len(x) // sizes.value[name])
        nodes = grow(x, name, small, spill, margin_of(threshold, x.shape[1]))
        return pa.table({c: pa.array([n[i] for n in nodes], t) for i, (c, t) in enumerate((("key", pa.int64()), ("low", pa.float64()), ("high", pa.float64())))})

    drawn = classes.select("id", "v").mapInArrow(draw, "leaf long, v binary")
    return [tuple(r) for r in drawn.groupBy("leaf").applyInArrow(fit, "key long, low double, high double").collect()]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, most: int = MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with
    nothing: n_links 0, their own id as component (null for none), kept. Vectors of different lengths don't link. Rows that
    share an id count as one vector, which has the links of all of them and links with itself by none of them. Pairs
    with a cosine of exactly the threshold link. Further columns are ignored. No rows give an empty result.

    Leaves of more than ``most`` vectors are split further on samples of their own, until none is left that planes
    can split; what stays larger, a tight group, is dealt out as pairs of chunks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    classes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"), F.count(F.lit(1)).alias("c"))
    classes = written(classes)
    count, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    drawn = classes.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    forest = spark.sparkContext.broadcast(fit_forest([np.array(r["v"]) for r in drawn], count, threshold, trees, leaf, spill))
    large, whole = large_leaves(classes, forest, most), set()
    while open_ := {name: c for name, c in large.items() if name not in whole}:
        nodes = subtrees(classes, forest, open_, threshold, leaf, spill)
        whole |= set(open_) - {n[0] for n in nodes}
        if not nodes or len(forest.value.keys) + len(nodes) > MOST_NODES:
            break
        forest = spark.sparkContext.broadcast(forest.value.grafted(nodes))
        large = large_leaves(classes, forest, most)
    chunks = spark.sparkContext.broadcast({name: -(-c // most) for name, c in large.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            for at, raw, x in _vectors(batch):
                with np.errstate(over="ignore"):
                    short = raw.astype(np.float32)
                sent = short if (short == raw).all() else raw
                found = [(np.full(len(rows), name), rows) for name, rows in forest.value.leaves(x)]
                name, row = (np.concatenate(c) for c in zip(*found, strict=True))
                by_row = np.lexsort((name, row))
                lists = np.split(name[by_row], np.flatnonzero(np.diff(row[by_row])) + 1)
                of = np.array([chunks.value.get(k, 1) for k in name.tolist()])
                own = ids[at[row]] % of
                other = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
                name, row, own = (np.repeat(c, of) for c in (name, row, own))
                for lo in range(0, len(name), 20_000):  # vectors are written once per leaf, or per chunk of it
                    k, r, o, p = (c[lo : lo + 20_000] for c in (name, row, own, other))
                    columns = [pa.array(k), pa.array(np.minimum(o, p)), pa.array(np.maximum(o, p)), pa.array(o), pa.array(ids[at[r]]), pa.array(n[at[r]])]
                    columns += [pa.array([sent[i].tobytes() for i in r], pa.binary()), pa.array(np.full(len(k), x.shape[1])), pa.array([lists[i] for i in r], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["leaf", "a", "b", "chunk", "id", "n", "v", "dim", "leaves"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        here = group.column("leaf")[0].as_py()
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        kinds = {(w := group.column("dim")[0].as_py()) * 4: np.float32, w * 8: np.float64}  # by the bytes of a vector
        x = unit_rows(np.stack([np.frombuffer(v, kinds[len(v)]) for v in group.column("v").to_pylist()]))
        lists = group.column("leaves").combine_chunks()
        owner, held = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()
        owner, held = owner[held < here], held[held < here]
        names, column = np.unique(held, return_inverse=True)
        earlier = np.zeros((len(ids), len(names)), np.float32)
        earlier[owner, column] = 1
        apart = group.column("a")[0].as_py() != group.column("b")[0].as_py()
        links, label = leaf_links(x, ids, n, earlier, threshold, group.column("chunk").to_numpy() if apart else None)
        return pa.table({"id": ids, "links": links, "label": label})

    dealt = classes.mapInArrow(deal, "leaf long, a long, b long, chunk long, id long, n long, v binary, dim long, leaves array<long>")
    found = written(dealt.groupBy("leaf", "a", "b").applyInArrow(compare, "id long, links long, label long"))
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id != label"), "id", "label")
    of_class = classes.join(direct, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    of_class = written(of_class.select("v", "c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    drop(classes, found)
    linked = join_back(rows.where("ok").select("vec_id", "v"), of_class, ["v"], total).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) >= {THRESHOLD} * a.norm * b.norm),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON v.vec_id = c.node
"""
