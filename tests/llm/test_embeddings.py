import numpy as np
import pytest

from sluice.llm import embeddings, queries
from sluice.operators.components import components
from tests.llm.helpers import oracle, same_rows


def brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for i, v in ok:
        for j, w in ok:
            if i != j and len(v) == len(w) and v @ w >= threshold * np.sqrt((v @ v) * (w @ w)):
                links[i].add(j)
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        out.append((i, len(links[i]), min(x for x in seen) if i is not None else None))
    return out


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.01"
    same_rows(queries.op4_embeddings(spark, sf), oracle(sf, embeddings.ORACLE, "embeddings"))


@pytest.mark.parametrize("leaf, most", [(512, 2048), (40, 2048), (512, 50), (40, 20)])
def test_groups_and_odd_vectors(spark, leaf, most):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 16), (2001, None), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None]), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [1e200, 2e200]), (None, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table, sample=300, leaf=leaf, most=most).collect()}
    want = {i: (n, c) for i, n, c in brute(rows)}
    assert set(got) == set(want) and got[None] == (0, None, True)
    found, all_ = (sum(x[i][0] for i in want) for x in (got, want))
    assert found <= all_ and found >= (0.9 if leaf == 40 else 1.0) * all_
    if leaf == 512:  # one leaf holds all, as pairs of chunks if it is too large
        assert {i: g[:2] for i, g in got.items()} == want
    assert all(g[2] == (g[1] == i) for i, g in got.items() if i is not None)
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_leaf_links_count_once():
    x = embeddings.unit_rows(np.array([[1, 0], [1, 0.01], [1, 0.02], [0, 1.0]]))
    earlier = np.array([[1], [1], [0], [0]], np.float32)
    links, label = embeddings.leaf_links(x, np.array([7, 9, 5, 6]), np.array([1, 2, 3, 4]), earlier, 0.9)
    assert links.tolist() == [3, 3, 3, 0] and label.tolist() == [5, 5, 5, 6]


def test_recall_against_brute_force_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 64))
    b = a[:1500] + 0.48 * rng.standard_normal((1500, 64))  # cosine around 0.9
    x = embeddings.unit_rows(np.vstack([a, b]))
    member = [set() for _ in range(len(x))]
    for leaf, rows in embeddings.fit_forest([v for v in x[::3]], len(x), 0.9, leaf=128).leaves(x):
        for r in rows:
            member[r].add(leaf)
    pairs = [(i, 3000 + i) for i in range(1500) if x[i] @ x[3000 + i] >= 0.9]
    assert len(pairs) > 300
    assert sum(bool(member[i] & member[j]) for i, j in pairs) >= 0.95 * len(pairs)


def test_large_leaves_are_split_on_their_own_rows(spark):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 24))
    x = embeddings.unit_rows(np.vstack([a, a[:600] + 0.4 * rng.standard_normal((600, 24)), np.tile(a[:1], (300, 1)) + 0.01 * rng.standard_normal((300, 24))]))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table, sample=60, leaf=64, most=256).collect()}
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    assert all(got[i]["n_links"] <= want[i] for i in range(len(x))) and sum(got[i]["n_links"] for i in range(len(x))) >= 0.95 * want.sum()
    # the sample of 60 alone gives leaves of a quarter of all
    forest = spark.sparkContext.broadcast(embeddings.fit_forest([v for v in x[:60]], len(x), 0.9, leaf=64))
    classes = table.selectExpr("vec_id AS id", "embedding AS v")
    large = embeddings.large_leaves(classes, forest, 256)
    more = forest.value.grafted(embeddings.subtrees(classes, forest, large, 0.9, 64, embeddings.SPILL))
    assert len(more.keys) > 4 * len(forest.value.keys) and sum(large.values()) > len(x)
    assert np.median([len(rows) for _, rows in more.leaves(x)]) < 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (205, 200), (200, 205)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 61), 10), **dict.fromkeys(range(100, 140), 100), 200: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
