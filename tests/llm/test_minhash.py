import re

import numpy as np
import pytest

from sluice.llm import minhash, queries
from tests.llm.helpers import oracle, same_rows


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), float("inf") if d is None else d)
    return sorted((str(d), len(sets[i]), str(least[find(i)]) if least[find(i)] != float("inf") else "None") for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def family(rng, n, size, edits):
    base = [f"w{rng.integers(1000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            own[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [minhash.BLOCK_SHINGLES, 300])
def test_families_copies_and_odd_texts(spark, block, monkeypatch):
    if block == 300:
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        monkeypatch.setattr(minhash, "BAND_ROWS", 5)
    rng = np.random.default_rng(4)
    texts = [t for size in (4, 6, 9, 30, 120) for t in family(rng, 24, size, max(1, size // 12))]
    texts += ["One  two\x0bTHREE", "one two three", "one two", "", " \n", None, "é a b c d", "É a b c d", "one two three"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[1]), (None, texts[0]), (None, "alone in the world of words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = minhash.near_duplicates(docs, words=4, block_shingles=block)
    assert got(df) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect() if r["doc_id"] is not None)


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op6_minhash(spark, sf)
    assert got(found) == brute(rows, 4, 80)
    same_rows(found, oracle(sf, minhash.ORACLE, "documents"))


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 50_000}" for i in range(60_000)]
    near, far = list(words), list(words)
    near[::50] = ["x"] * len(near[::50])
    far[::10] = ["y"] * len(far[::10])
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "z" * 2_000_000)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4, 80)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_estimate_and_band():
    rng = np.random.default_rng(0)
    for n in (5, 40, 2000):
        errors, met = [], []
        for _ in range(100):
            u = rng.integers(0, 2**63, n).astype(np.uint64)
            c = round(0.8 * n)
            a, b = np.sort(u[: c + (n - c) // 2]), np.sort(np.concatenate([u[:c], u[c + (n - c) // 2 :]]))
            x, y = minhash.sketch(a), minhash.sketch(b)
            errors.append(minhash.estimate((x == y).sum()) - c / n)
            met.append((minhash.bands(x[None]) == minhash.bands(y[None])).any())
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05 and all(met)


def test_join_block_compares_sets_in_full():
    sets = [np.arange(0, 10), np.arange(1, 11), np.arange(0, 9), np.arange(100, 103), np.arange(2, 12)]
    sets = [s.astype(np.uint64) for s in sets]
    sketches = np.stack([minhash.sketch(s) for s in sets])
    assert minhash.join_block(sets, sketches, 80).tolist() == [0, 0, 0, 3, 0]
    assert minhash.join_block(sets, sketches, 80, np.array([0, 0, 1, 1, 1])).tolist() == [0, 1, 0, 3, 1]


def test_estimates_prune_no_link():
    """Pairs at the threshold, over set sizes: none is further below it than SLACK, and the spread is what SPREAD says."""
    rng = np.random.default_rng(3)
    for n in (5, 10, 45, 180, 900, 5000):
        errors = []
        for _ in range(200):
            u = rng.integers(0, 2**63, n).astype(np.uint64)
            c = int(np.ceil(0.8 * n))
            a, b = np.sort(u[: c + (n - c) // 2]), np.sort(np.concatenate([u[:c], u[c + (n - c) // 2 :]]))
            equal = (minhash.sketch(a) == minhash.sketch(b)).sum()
            errors.append(minhash.estimate(equal) - c / n)
            assert minhash.passing(80)[equal]
        assert np.std(errors) < 1.1 * minhash.SPREAD


def test_join_sketches_connects_by_estimates():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (3, 300)).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[i % 3][20:], rng.integers(0, 2**63, 20).astype(np.uint64)])) for i in range(12)]
    sketches, sizes = np.stack([minhash.sketch(s) for s in sets]), np.array([len(s) for s in sets])
    assert minhash.join_sketches(sizes, sketches, 80).tolist() == [0, 1, 2] * 4
    assert minhash.join_sketches(sizes, sketches, 80, np.arange(12) // 3).tolist() == [0, 1, 2] * 4
    assert minhash.join_sketches(sizes, sketches, 80, np.zeros(12, int)).tolist() == list(range(12))


@pytest.mark.parametrize("bound", [minhash.BROADCAST_IDS, 0])
def test_band_keys_are_not_joined_by_a_shuffle_within_the_bound(spark, bound, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", bound)
    asked, whole = [], minhash.join_back
    monkeypatch.setattr(minhash, "join_back", lambda rows, groups, keys, *a: asked.append(keys) or whole(rows, groups, keys, *a))
    rows = list(enumerate(family(np.random.default_rng(15), 20, 30, 2)))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4, 80)
    assert (["band"] in asked) == (bound == 0)
