"""Iterative graph algorithms over DataFrames. Each round ends in a table in the shared folder, which cuts its lineage."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.session import drop, written

DAMPING = 0.85
ROUNDS = 60


def walk(hops: DataFrame, rounds: int = 40) -> DataFrame:
    """Chains of hops: (root, pos, src, txid, t, next_wallet, peel_sink, skew), from every source that no hop leads to.

    Pointer doubling: after k rounds every chain's first 2^k hops are known, and so is for each hop the one 2^k further on, so a
    chain of n hops takes log n rounds. A chain that runs into a cycle ends before the first wallet that it has seen;
    a cycle without a root isn't reported.
    """
    hops = written(hops)
    nexts = hops.select(F.col("next_wallet").alias("src")).distinct()
    known = written(hops.join(nexts, "src", "left_anti").select(F.col("src").alias("root"), F.lit(0).cast("long").alias("pos"), "src"))
    leap = hops.select("src", F.col("next_wallet").alias("to")).join(hops.select(F.col("src").alias("to")), "to")
    reach, count = 1, known.count()
    for _ in range(rounds):
        leap = written(leap.select("src", "to"))
        further = known.join(leap, "src").select("root", (F.col("pos") + reach).alias("pos"), F.col("to").alias("src"))
        known = written(known.unionByName(further).groupBy("root", "src").agg(F.min("pos").alias("pos")))
        now = known.count()
        if now == count:
            break
        count, reach = now, 2 * reach
        after = leap.select(F.col("src").alias("to"), F.col("to").alias("then"))
        leap = leap.join(after, "to").select("src", F.col("then").alias("to"))
    return known.join(hops, "src").select("root", "pos", "src", "txid", "t", "next_wallet", "peel_sink", "skew")


#: Rounds of a walk that are kept as tables of their own; what still moves then is carried on as one.
KEPT_ROUNDS = 20


def personalized_pagerank(transition: DataFrame, restarts: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, kept: int = KEPT_ROUNDS) -> DataFrame:
    """(wallet, seeded, flat): both walks as two columns of one loop, all their rounds.

    ``transition``: (src, dst, p), the p of a src summing to 1; ``restarts``: (wallet, seeded, flat), each summing to
    1. What a wallet without outgoing edges holds returns to the restarts.

    With s the restarts, P the moves and c_k = 1 - damping + damping times what was lost in round k - 1 (c_0 = 1), a round is
    r_k = damping P r_(k-1) + c_k s, so r_k is the sum over j of damping^j c_(k-j) P^j s. The tables P^j s don't depend on what is lost:
    a round reads only the wallets that it still reaches, and in a graph without cycles nothing is left after its longest
    path. What is left after ``kept`` rounds goes on by the plain recursion, with P^kept s in place of s.
    """
    names = ("seeded", "flat")
    sources = transition.select(F.col("src").alias("wallet")).distinct().withColumn("flows", F.lit(True))
    start = written(restarts.join(sources, "wallet", "left").select("wallet", *names, F.col("flows").isNull().alias("ends")))
    edges = written(transition.join(start.select(F.col("wallet").alias("dst"), "ends"), "dst").select("src", "dst", "p", "ends"))

    def moved(held: DataFrame) -> DataFrame:
        out = edges.join(held.where("NOT ends").select(F.col("wallet").alias("src"), *names), "src").groupBy("dst", "ends").agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in names])
        return out.select(F.col("dst").alias("wallet"), *names, "ends")

    def ended(held: DataFrame) -> tuple[int, list[float]]:
        row = held.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.when(F.col("ends"), F.col(c))), F.lit(0.0)) for c in names]).first()
        return row[0], list(row[1:])

    steps, lost = [start], [ended(start)[1]]
    while len(steps) < rounds + 1:
        step = written(moved(steps[-1]))
        n, at_ends = ended(step)
        if not n or len(steps) == kept:
            break
        steps.append(step)
        lost.append(at_ends)
    else:
        n = 0
    seed, tail, c = (step if n else None), None, [[1.0, 1.0]]
    for k in range(rounds + 1):
        if k:
            c.append([(1 - damping) + damping * z for z in gone])
        if seed is not None and k >= len(steps):
            entry = seed.select("wallet", *[(F.lit(damping ** len(steps) * c[k - len(steps)][i]) * F.col(x)).alias(x) for i, x in enumerate(names)], "ends")
            after = entry if tail is None else moved(tail).select("wallet", *[(damping * F.col(x)).alias(x) for x in names], "ends").unionByName(entry).groupBy("wallet", "ends").agg(*[F.sum(x).alias(x) for x in names])
            after = written(after.select("wallet", *names, "ends"))
            if tail is not None:
                drop(tail)
            tail = after
        gone = [sum(damping**j * c[k - j][i] * lost[j][i] for j in range(min(k + 1, len(steps)))) for i in range(2)]
        if tail is not None and k < rounds:
            gone = [g + z for g, z in zip(gone, ended(tail)[1], strict=True)]
    parts = [held.select("wallet", *[(F.lit(damping**j * c[rounds - j][i]) * F.col(x)).alias(x) for i, x in enumerate(names)]) for j, held in enumerate(steps)]
    parts += [] if tail is None else [tail.select("wallet", *names)]
    rank = reduce(DataFrame.unionByName, parts).groupBy("wallet").agg(*[F.sum(x).alias(x) for x in names])
    rank = written(rank)
    drop(*steps, edges, *([] if seed is None else [seed]), *([] if tail is None else [tail]))
    sums = rank.agg(F.sum("seeded").alias("s"), F.sum("flat").alias("f"))
    return rank.crossJoin(F.broadcast(sums)).select("wallet", (F.col("seeded") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("seeded"), (F.col("flat") / F.when(F.col("f") > 0, F.col("f")).otherwise(1.0)).alias("flat"))


def path_bfs(edges: DataFrame, source: str, target: str, cut: int = 20) -> DataFrame:
    """(pos, node, edge): a path of fewest edges from source to target, the edges' smallest seq deciding between them; the
    source alone if it is the target, nothing if there is no path. ``edges``: (seq, src, dst). The frontier goes level by level, until it has the target or is
    empty; what has been reached isn't reached again, and every ``cut`` levels it is written as one table."""
    spark = edges.sparkSession
    first = written(edges.where("src != dst").groupBy("src", "dst").agg(F.min("seq").alias("seq")))
    seen = written(spark.createDataFrame([(source, None, None, 0)], "node string, parent string, edge long, level int"))
    for level in count(1):
        if not seen.where(F.col("node") == target).isEmpty():
            break
        step = seen.where(F.col("level") == level - 1).join(first, F.col("node") == F.col("src"))
        step = step.groupBy("dst").agg(F.min(F.struct("seq", "src")).alias("best")).select(F.col("dst").alias("node"), F.col("best.src").alias("parent"), F.col("best.seq").alias("edge"), F.lit(level).alias("level"))
        step = written(step.join(seen.select("node"), "node", "left_anti"))
        if step.isEmpty():
            return spark.createDataFrame([], "pos int, node string, edge long")
        seen = seen.unionByName(step)
        if level % cut == 0:
            seen = written(seen)
    path, at = [], target
    while at is not None:  # one row for each edge of one path
        row = seen.where(F.col("node") == at).first()
        if row is None:
            return spark.createDataFrame([], "pos int, node string, edge long")
        path.append((row["level"], at, row["edge"]))
        at = row["parent"]
    return spark.createDataFrame(path, "pos int, node string, edge long")


def trails(edges: DataFrame, target: str, longest: int = 5) -> DataFrame:
    """(nodes, n_hops): trails (no edge twice) of 1 to ``longest`` edges that end at ``target`` and visit no node twice.
    ``edges``: (seq, src, dst). Each join is narrowed to what can still reach the target."""
    e = written(edges.select("src", "dst").where("src != dst"))
    out = now = e.where(F.col("dst") == target).select(F.array("src", "dst").alias("nodes"))
    for i in range(1, longest):  # what visits a node twice stays so when it grows, and what doesn't uses no edge twice
        now = now.withColumn("head", F.col("nodes")[0]).join(e, F.col("head") == e.dst).where(~F.array_contains("nodes", F.col("src")))
        now = now.select(F.concat(F.array("src"), "nodes").alias("nodes"))
        now = written(now) if i < longest - 1 else now
        out = out.unionByName(now)
    return out.select(F.array_join("nodes", "|").alias("nodes"), (F.size("nodes") - 1).cast("long").alias("n_hops"))


def longest_trails(edges: DataFrame, target: str, longest: int = 5, top: int = 10, beam: int = 1000) -> DataFrame:
    """(nodes, n_hops): the ``top`` longest of the ``trails`` to ``target``; of equally long ones those whose edges, from the target
    back, have the smaller seqs.

    In this order everything that grows from an earlier trail comes before what grows from a later one. So the first
    ``beam`` trails of each length are enough, if ``top`` of the full length come of them; if not, the beam is widened
    until they do or nothing is left out. Each join is with one bounded, broadcast table. Null seqs aren't expected.
    """
    e = written(edges.select("seq", "src", "dst").where("src != dst"))
    while True:
        now, levels, cut = None, [], False
        for i in range(longest):
            if now is None:
                now = e.where(F.col("dst") == target).select(F.array("seq").alias("key"), F.array("src", "dst").alias("nodes"))
            else:
                now = e.join(F.broadcast(now.withColumn("head", F.col("nodes")[0])), F.col("head") == e.dst).where(~F.array_contains("nodes", F.col("src")))
                now = now.select(F.concat("key", F.array("seq")).alias("key"), F.concat(F.array("src"), "nodes").alias("nodes"))
            now = written(now.orderBy("key").limit(beam + 1))
            n = now.count()
            cut |= n > beam
            now = now.orderBy("key").limit(beam)
            levels.append(now)
        if not cut or n >= top:
            break
        beam *= 8
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = found.orderBy(F.size("nodes").desc(), "key").limit(top)
    return found.select(F.array_join("nodes", "|").alias("nodes"), (F.size("nodes") - 1).cast("long").alias("n_hops"))


def hops_between(edges: DataFrame, longest: int = 3) -> DataFrame:
    """(dst, src): distinct pairs linked by trails of 1 to ``longest`` edges; each level is made distinct before the next."""
    e = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    now, out = e, e
    for _ in range(longest - 1):
        now = written(now.withColumnRenamed("dst", "mid").join(e.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct())
        out = out.union(now)
    return out.distinct()


#: Edges whose targets are broadcast as numbers, four bytes each; a graph of more goes through joins.
BROADCAST_EDGES = 50_000_000
#: Names of nodes that are broadcast to number the edges; of more they are joined.
BROADCAST_NAMES = 200_000


#: Pairs of one batch.
PAIRS = 100_000
#: Nodes that walk side by side, a bit each, at most (fewer where there are few targets), and nodes of a task.
SIDE, NODES = 12, 4096
#: Targets of a task, by number and by bytes: a dictionary of them fits a Parquet file's page of a megabyte and has numbers of two bytes.
SLICE_NAMES, SLICE_BYTES = 1 << 16, 1_000_000


class Steps:
    """The targets of each node of a graph as numbers in one array, in every task; ``names``: the nodes in the order of their numbers."""

    def __init__(self, names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        order = np.argsort(src, kind="stable")
        self.names, self.dst = names, dst[order].astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))])

    def targets(self, nodes: np.ndarray) -> np.ndarray:
        """The target of each edge from ``nodes``."""
        first, n = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
        return self.dst[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def distinct(self, nodes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """``nodes`` once each, in order. ``seen``: no node is marked, before and after."""
        if len(nodes) < len(seen) // 64:
            return np.unique(nodes)
        seen[nodes] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found

    def after(self, nodes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The distinct targets of the edges from ``nodes``."""
        return self.distinct(self.targets(nodes), seen)

    def into(self, lo: int, hi: int) -> Steps:
        """The same nodes with the edges to ``lo`` and beyond, before ``hi``."""
        out, keep = copy(self), (self.dst >= lo) & (self.dst < hi)
        out.dst, out.begin = self.dst[keep], np.append(np.int32(0), np.cumsum(keep, dtype=np.int32))[self.begin]
        return out


def steps_of(edges: DataFrame, back: bool = False) -> Steps | None:
    """Of (src, dst), distinct and without nulls, or of the edges turned ``back``; None if they are too many to broadcast."""
    if edges.count() > BROADCAST_EDGES:
        return None
    names = np.sort(edges.select("src").union(edges.select("dst")).distinct().toArrow()["src"].to_numpy())
    names = names[np.argsort(np.fromiter(map(len, names), int, len(names)), kind="stable")]  # numbered ids that are close stand together
    numbers = pa.table({"name": pa.array(names, pa.string()), "i": pa.array(np.arange(len(names), dtype=np.int32))})
    ids = written(edges.sparkSession.createDataFrame(numbers))
    near = F.broadcast if len(names) <= BROADCAST_NAMES else lambda df: df
    pairs = edges.join(near(ids.toDF("src", "a")), "src").join(near(ids.toDF("dst", "b")), "dst").select("a", "b").toArrow()
    drop(ids)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    return Steps(names, b, a) if back else Steps(names, a, b)


def reached_from(edges: DataFrame, longest: int = 3) -> DataFrame:
    """(id, sources): from how many nodes, itself included if it lies on such a cycle, each node is reached by 1 to ``longest`` edges. Every
    node walks back over the edges by itself, so no pairs are written or shuffled; a graph of too many edges goes through ``hops_between``."""
    spark = edges.sparkSession
    e = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    steps = steps_of(e, back=True)
    if steps is None:
        return hops_between(e, longest).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("sources"))
    drop(e)
    shared, n = spark.sparkContext.broadcast(steps), len(steps.names)

    def count_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        seen = np.zeros(n, bool)
        for batch in batches:
            ids, sources = [], []
            for i in batch.column(0).to_pylist():
                now = steps.after(np.array([i]), seen)
                reached = now
                for _ in range(longest - 1):
                    now = np.setdiff1d(steps.after(now, seen), reached, assume_unique=True)
                    reached = np.concatenate([reached, now])
                if len(reached):
                    ids.append(str(steps.names[i]))
                    sources.append(len(reached))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sources, pa.int64())], names=["id", "sources"])

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, tasks).mapInArrow(count_back, "id string, sources long")


def _hops(now: DataFrame, e: DataFrame, least: int, longest: int, back: bool = False) -> DataFrame:
    """(src, dst): trails of ``least`` to ``longest`` edges that begin with ``now``, or end with it; each level is made distinct before the next."""
    levels = [now]
    for _ in range(longest - 1):
        a, b = (e, levels[-1]) if back else (levels[-1], e)
        levels.append(a.withColumnRenamed("dst", "mid").join(b.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct())
    return reduce(DataFrame.union, levels[least - 1 :])


def _by_kind(nodes: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(src, dst) in batches: bit k of ``marks`` says that ``nodes[k]`` reaches a target; no mark is left after. Targets that the same of the nodes
    reach stand together, once for each of these nodes, so what is written of them repeats and packs well."""
    found = np.flatnonzero(marks)
    kinds = marks[found]
    marks[found] = 0
    order = np.argsort(kinds, kind="stable")
    found, kinds = found[order], kinds[order]
    begin = np.flatnonzero(np.diff(kinds, prepend=kinds.dtype.type(0)))  # no kind is 0
    src, dst, size = [], [], 0
    for lo, hi in zip(begin, [*begin[1:], len(found)], strict=False):
        who = nodes[np.flatnonzero(int(kinds[lo]) >> np.arange(len(nodes)) & 1)]
        for at in range(lo, hi, PAIRS // SIDE):
            some = found[at : min(at + PAIRS // SIDE, hi)]
            src.append(np.repeat(who, len(some)))
            dst.append(np.tile(some, len(who)))
            size += len(src[-1])
            if size >= PAIRS:
                yield np.concatenate(src), np.concatenate(dst)
                src, dst, size = [], [], 0
    if size:
        yield np.concatenate(src), np.concatenate(dst)


def pairs_within(edges: DataFrame, least: int = 1, longest: int = 3) -> DataFrame:
    """(src, dst): distinct pairs linked by trails of ``least`` to ``longest`` edges. Every node walks by itself and gives its pairs, each once,
    so none is shuffled or written on the way; a graph of too many edges, and what begins or ends with null, goes through joins."""
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").distinct())
    open_ends = _hops(e.where("src IS NULL"), e, least, longest).union(_hops(e.where("dst IS NULL"), e, least, longest, back=True)).distinct()
    has_null = not e.where("src IS NULL OR dst IS NULL").isEmpty()
    whole = e.where("src IS NOT NULL AND dst IS NOT NULL")
    steps = steps_of(whole)
    if steps is None:
        out = _hops(whole, whole, least, longest).distinct()
        return out.union(open_ends) if has_null else out
    shared, n = spark.sparkContext.broadcast(steps), len(steps.names)

    dense = (len(steps.dst) / max(1, n)) ** longest * SIDE >= min(n, SLICE_NAMES)  # if not, walks side by side have few targets in common
    size = sum(map(len, steps.names)) + 4 * n
    slices = max(1, -(-n // SLICE_NAMES), -(-size // SLICE_BYTES)) if dense else 1
    edge = np.linspace(0, n, slices + 1).astype(int)
    side = max(1, min(SIDE, (n // slices).bit_length() - 4)) if dense else 1  # so that there are several targets of each kind

    def walk_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        names = pa.array(steps.names, pa.string())
        seen, marks, at = np.zeros(n, bool), np.zeros(n, np.uint16), None
        for batch in batches:
            of, ids = np.divmod(batch.column(0).to_numpy(), n)
            for part in np.unique(of):
                if part != at:
                    at, lo, hi = part, edge[part], edge[part + 1]
                    last = steps.into(lo, hi) if slices > 1 else steps
                whole = ids[of == part]
                for nodes in (whole[i : i + side] for i in range(0, len(whole), side)):
                    for k, i in enumerate(nodes):
                        now = np.array([i])
                        for hop in range(1, longest + 1):
                            if hop >= least:
                                marks[last.targets(now)] |= np.uint16(1 << k)
                            if hop < longest:
                                now = steps.after(now, seen)
                    for src, dst in _by_kind(nodes, marks[lo:hi]):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(src)), names.take(pa.array(dst + lo))], names=["src", "dst"])

    tasks = max(1, min(n * slices, max(4 * spark.sparkContext.defaultParallelism, -(-n // NODES) * slices)))
    out = spark.range(0, n * slices, 1, tasks).mapInArrow(walk_on, "src string, dst string")
    return out.union(open_ends) if has_null else out


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with n, each row's number in ``order``, and total. Rows are dealt by ranges and numbered within each; the ranges'
    sizes, one row for each task, say where its numbers begin. ``drop`` of the result deletes the ranges."""
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["c"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(sizes.values())
    before = [(p, sum(c for q, c in sizes.items() if q < p)) for p in sizes] or [(0, 0)]
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")
    out = dealt.join(F.broadcast(starts), "_part").withColumn("n", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    out = out.withColumn("total", F.lit(total).cast("long")).drop("_part", "_before")
    out._written_to = dealt._written_to
    return out
