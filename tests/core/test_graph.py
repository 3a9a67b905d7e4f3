from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sluice.operators import graph, ml
from sluice.operators.components import components
from sluice.operators.transfers import ACCOUNT
from sluice.plans import registry, relations


def test_walk_branches_merges_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("r", "p"), ("p", "q"), ("q", "p"), ("m", "n"), ("n", "m")]
    hops = spark.createDataFrame([(s, "t" + s, i, n, "sink", 1.0, 9.0, 0.1) for i, (s, n) in enumerate(pairs)], "src string, txid string, t long, next_wallet string, peel_sink string, peeled double, remainder double, skew double")
    got = {}
    for r in graph.walk(hops).collect():
        got.setdefault(r["root"], []).append((r["pos"], r["src"]))
    assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == {"a": ["a", "b", "c"], "x": ["x", "c"], "r": ["r", "p", "q"]}


def test_long_chain_takes_few_rounds(spark):
    hops = spark.range(300).selectExpr("concat('w', id) AS src", "'t' AS txid", "id AS t", "concat('w', id + 1) AS next_wallet", "'s' AS peel_sink", "0.1D AS skew")
    found = graph.walk(hops, rounds=12)
    assert found.count() == 300 and found.agg({"pos": "max"}).first()[0] == 299


def test_pagerank_sums_to_one_and_equals_numpy(spark):
    n = 6
    p = np.zeros((n, n))
    p[0, 1], p[0, 2], p[1, 2], p[2, 0], p[3, 2] = 0.5, 0.5, 1, 1, 1
    seeds, flat = np.array([0.5, 0, 0, 0.5, 0, 0]), np.full(n, 1 / n)
    want = []
    for restart in (seeds, flat):
        r = restart.copy()
        for _ in range(12):
            r = 0.85 * r @ p + (0.15 + 0.85 * r[p.sum(axis=1) == 0].sum()) * restart
        want.append(r / r.sum())
    edges = spark.createDataFrame([(str(i), str(j), float(p[i, j])) for i in range(n) for j in range(n) if p[i, j]], "src string, dst string, p double")
    restarts = spark.createDataFrame([(str(i), float(seeds[i]), float(flat[i])) for i in range(n)], "wallet string, seeded double, flat double")
    got = {r["wallet"]: (r["seeded"], r["flat"]) for r in graph.personalized_pagerank(edges, restarts, rounds=12).collect()}
    assert np.allclose([got[str(i)] for i in range(n)], np.array(want).T) and np.isclose(sum(v[0] for v in got.values()), 1)


def test_pagerank_reads_only_what_is_still_reached(spark, monkeypatch):
    """A graph whose longest path has two edges is through after two rounds; cycles go on beyond the tables that are kept."""
    made, whole = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: made.append(1) or whole(df))
    restarts = spark.createDataFrame([(c, 0.25, 0.25) for c in "abcd"], "wallet string, seeded double, flat double")
    line = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, p double")
    p = np.zeros((4, 4))
    p[0, 1] = p[1, 2] = 1
    for edges, kept in ((line, 20), (line.union(spark.createDataFrame([("c", "a", 1.0)], line.schema)), 3)):
        if kept == 3:
            p[2, 0] = 1
        rank = np.full(4, 0.25)
        for _ in range(60):
            rank = 0.85 * rank @ p + (0.15 + 0.85 * rank[p.sum(axis=1) == 0].sum()) / 4
        made.clear()
        got = {r["wallet"]: (r["seeded"], r["flat"]) for r in graph.personalized_pagerank(edges, restarts, kept=kept).collect()}
        assert np.allclose([got[w] for w in "abcd"], np.array([rank, rank]).T / rank.sum(), atol=1e-12)
        assert kept == 3 or len(made) <= 6


def test_convergence_writes_no_pairs(spark, monkeypatch):
    """Counts of sources equal those of the pairs, by broadcast and beyond its bound; pairs are only made beyond it."""
    rng = np.random.default_rng(11)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (90, 2))] + [(None, "n1"), ("n2", None)]
    transfers = spark.createDataFrame(pairs, "sender_id string, receiver_id string")
    near = {(a, b) for a, b in pairs if a and b}
    reach, now = set(near), near
    for _ in range(2):
        now = {(a, d) for a, b in now for c, d in near if b == c}
        reach |= now
    want = {d: len({a for a, b in reach if b == d}) for _, d in reach}
    made, whole = [], graph.hops_between
    monkeypatch.setattr(graph, "hops_between", lambda *a: made.append(1) or whole(*a))
    for bound in (graph.BROADCAST_EDGES, 0):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", bound)
        got = {r["id"]: r["sources"] for r in registry.run(spark, "convergence", transfers=transfers).collect()}
        assert got == {d: n for d, n in want.items() if n >= 3} and len(made) == (bound == 0)


def test_paths_and_trails(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c"), (4, "c", "d"), (5, "d", "a"), (6, "a", "c")], "seq long, src string, dst string")
    assert [(r["node"], r["edge"]) for r in graph.path_bfs(edges, "a", "d").orderBy("pos").collect()] == [("a", None), ("c", 3), ("d", 4)]
    assert graph.path_bfs(edges, "a", "a").count() == 1 and graph.path_bfs(edges, "a", "zz").count() == 0
    assert sorted(r["nodes"] for r in graph.trails(edges, "d", 3).collect()) == ["a|b|c|d", "a|c|d", "a|c|d", "b|c|d", "c|d"]
    assert {(r["src"], r["dst"]) for r in graph.hops_between(edges, 2).collect()} >= {("a", "d"), ("d", "b"), ("c", "a")}


def test_reverse_chain_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    names = [ACCOUNT, *"abcdef"]
    pairs = [(str(a), str(b)) for a, b in rng.choice(names, (24, 2))] + [("w6", "w5"), ("w5", "w4"), ("w4", "w3"), ("w3", "w2"), ("w2", "w1"), ("w1", ACCOUNT)]
    want, open_ = [], [((), [ACCOUNT])]
    for _ in range(5):
        open_ = [((*key, i), [s, *nodes]) for key, nodes in open_ for i, (s, r) in enumerate(pairs) if r == nodes[0] and s not in nodes]
        want += [(-len(key), key, "|".join(nodes)) for key, nodes in open_]
    transfers = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(pairs)], "seq long, sender_id string, receiver_id string")
    assert len(want) > 10
    edges = transfers.select("seq", F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))
    assert sorted(r["nodes"] for r in graph.trails(edges, ACCOUNT).collect()) == sorted(nodes for _, _, nodes in want)
    first = [(nodes, -n) for n, _, nodes in sorted(want)[:10]]
    assert [tuple(r) for r in registry.run(spark, "reverse_chain", transfers=transfers).collect()] == first
    assert [tuple(r) for r in graph.longest_trails(edges, ACCOUNT, beam=1).collect()] == first
    assert graph.longest_trails(edges, "nobody").collect() == []


def test_numbered_equals_a_global_window(spark):
    rows = spark.range(500).selectExpr("id", "id * 37 % 50 AS v")
    got = {r["id"]: (r["n"], r["total"]) for r in graph.numbered(rows, F.asc("v"), F.desc("id")).collect()}
    order = sorted(range(500), key=lambda i: (i * 37 % 50, -i))
    assert got == {i: (n, 500) for n, i in enumerate(order, 1)}
    assert graph.numbered(rows.limit(0), F.asc("v")).collect() == []


def test_long_path_is_found(spark):
    edges = spark.range(53).selectExpr("id AS seq", "concat('w', id) AS src", "concat('w', id + 1) AS dst").coalesce(1)
    assert [r["node"] for r in graph.path_bfs(edges, "w0", "w53").orderBy("pos").collect()] == [f"w{i}" for i in range(54)]


def test_registered_ranks_take_sixty_rounds(spark, sf):
    ask = registry.registered()
    start = {r["wallet"]: (r["seeded"], r["flat"]) for r in registry._registered(spark, sf, "restarts").collect()}
    at = {w: i for i, w in enumerate(start)}
    restart = np.array(list(start.values()))
    p = np.zeros((len(at), len(at)))
    for r in registry._registered(spark, sf, "transition").collect():
        p[at[r["src"]], at[r["dst"]]] += r["p"]
    ends, rank = p.sum(axis=1) == 0, restart
    for _ in range(60):
        rank = 0.85 * p.T @ rank + (0.15 + 0.85 * rank[ends].sum(axis=0)) * restart
    rank = rank / rank.sum(axis=0)
    got = {r["wallet"]: (r["seeded"], r["flat"]) for r in ask["ppr"](spark, sf).collect()}
    assert got.keys() == at.keys() and np.allclose([got[w] for w in at], rank, atol=2e-8, rtol=0)


def test_components_of_strings(spark):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_isolation_forest_finds_the_odd_one(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (200, 2)))] + [("odd", 12.0, -9.0)]
    got = ml.isolation_scores(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x", "y"], trees=50).orderBy("score", ascending=False).first()
    assert got["k"] == "odd" and got["is_anomaly"] and abs(got["scaled"] - 100) < 1e-3


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 5))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, v array<double>").repartition(4)
    got = {(r["id"], r["other"]) for r in ml.neighbours_of(rows.where("id < 7"), rows, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, int(j)) for i in range(7) for j in np.argsort(-(unit[i] @ unit.T))[:4]}


def test_pairs_of_hops_are_neither_shuffled_nor_written(spark, monkeypatch):
    """two_hops and reach_three equal plain joins, by broadcast and beyond its bound; by broadcast the plan has no join and no exchange."""
    rng = np.random.default_rng(14)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 50, (80, 2))] + [(None, "n1"), ("n2", None), ("n3", "n3")]
    transfers = spark.createDataFrame(pairs, "sender_id string, receiver_id string")
    near = {(a, b) for a, b in pairs if a and b}
    two = {(a, d) for a, b in near for c, d in near if b == c}
    three = near | two | {(a, d) for a, b in two for c, d in near if b == c}
    for bound in (graph.BROADCAST_EDGES, 0):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", bound)
        for name, want in (("two_hops", two), ("reach_three", three)):
            open_ends = {tuple(r) for r in registry.run(spark, name, transfers=transfers).collect() if None in tuple(r)}
            assert open_ends == {tuple(r) for r in relations.query(spark, name, transfers=transfers).collect() if None in tuple(r)}
            found = registry.run(spark, name, transfers=transfers.where("sender_id IS NOT NULL AND receiver_id IS NOT NULL"))
            if bound:
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert "Exchange" not in plan and "Join" not in plan
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_hops_are_written_compactly(spark, tmp_path, monkeypatch):
    """What several nodes reach stands together, slice by slice of the targets: no pair is lost or made twice, and less is written than node by node, where each takes 1.5 bytes."""
    for name, small in (("SLICE_NAMES", 250), ("NODES", 500)):
        monkeypatch.setattr(graph, name, small, raising=False)
    rng = np.random.default_rng(17)
    n, near = 2000, [set() for _ in range(2000)]
    for a, b in rng.integers(0, n, (20_000, 2)).tolist():
        near[a].add(b)
    transfers = spark.createDataFrame([(f"ACC{100000 + a}", f"ACC{100000 + b}") for a in range(n) for b in near[a]], "sender_id string, receiver_id string")
    two = [set().union(*(near[b] for b in near[a])) for a in range(n)]
    three = [near[a] | two[a] | set().union(*(near[c] for c in two[a])) for a in range(n)]
    registry.run(spark, "reach_three", transfers=transfers).write.parquet(f"{tmp_path}/out")
    got = [set() for _ in range(n)]
    src, dst = (spark.read.parquet(f"{tmp_path}/out").toArrow()[c].to_pylist() for c in ("src", "dst"))
    for a, b in zip(src, dst, strict=True):
        got[int(a[3:]) - 100000].add(int(b[3:]) - 100000)
    assert got == three and len(src) == sum(map(len, three)) > 1_000_000
    assert sum(f.stat().st_size for f in Path(f"{tmp_path}/out").glob("*.parquet")) < 1.25 * len(src)
