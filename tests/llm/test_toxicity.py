import zlib

import numpy as np

from sluice.llm import queries, toxicity

CLEAN = ["the river of the town", "and a house by the sea", "in the night we walk", "bread for the people of it"]


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = " ".join(rng.choice(CLEAN, 6)).split()
        bad = i % 3 == 0
        if bad:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["grumpfen", "grumpfling", "vilest"])))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_learns_words_and_stems(spark):
    data = rows(300)
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in data] + [(900, "grumpfolio by the sea", 1.0), (901, "by the sea", 1.0), (None, None, 1.0), (901, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in data] + [(None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op8(docs, labels).collect()
    assert len(got) == 304
    by = {(r["doc_id"], r["score"]): r for r in got}
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {i: b for i, _, b in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert max(r["predicted"] for k, r in by.items() if k[0] == 900) == 1 and not any(r["predicted"] for k, r in by.items() if k[0] == 901)
    assert toxicity.op8(docs.limit(0), labels.limit(0)).collect() == []


def test_labels_of_held_out_rows_teach_nothing(spark):
    data = rows(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    swapped = [(i, 1, 1 - b if zlib.crc32(str(i).encode()) % 5 == 0 else b) for i, _, b in data]
    a = toxicity.training_rows(docs, spark.createDataFrame([(i, 1, b) for i, _, b in data], "doc_id long, quality int, toxic int"))
    assert a == toxicity.training_rows(docs, spark.createDataFrame(swapped, "doc_id long, quality int, toxic int"))
    assert 0 < len(a[0]) < 60 and len(toxicity.training_rows(docs, spark.createDataFrame(swapped, "doc_id long, quality int, toxic int"), 5)[0]) == 10


def test_whole_texts_teach(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(240):
        words = " ".join(rng.choice(CLEAN, 1500)).split()
        if i % 2:
            words[: 20] = ["grumpfen"] * 20  # thousands of words before the middle
        data.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in data], "doc_id long, quality int, toxic int")
    texts, _ = toxicity.training_rows(docs, labels)
    assert min(len(t) for t in texts) > 24_000 and set(texts) <= {t for _, t, _ in data}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op8(docs, labels).collect()}
    assert np.mean([got[i] == b for i, _, b in data]) > 0.95


def test_strongest_places_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    embedding, filters = rng.normal(0, 1, (50, 12)), [rng.normal(0, 1, (w, 12, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    for n in (0, 1, 2, 6, 7, 8, 9, 100):
        a, b = rng.integers(0, 50, (2, n))
        whole = toxicity.strongest(a, b, embedding, filters)
        monkeypatch.setattr(toxicity, "PLACES", 7)
        parts = toxicity.strongest(a, b, embedding, filters)
        monkeypatch.undo()
        assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_pooling_reads_all_in_blocks():
    rng = np.random.default_rng(1)
    tables = [[rng.standard_normal((50, 4)).astype("f4") for _ in range(w)] for w in (1, 2, 3)]
    a, b = rng.integers(0, 50, (2, 120_001))
    whole = np.concatenate([sum(t[k][a[k : len(a) - len(t) + 1 + k]] + t[k][b[k : len(b) - len(t) + 1 + k]] for k in range(len(t))).max(axis=0) for t in tables])
    assert np.allclose(toxicity.pooled(a, b, tables), whole)
    assert np.allclose(toxicity.pooled(a[:2], b[:2], tables)[8:], 0) and not toxicity.pooled(a[:0], b[:0], tables).any()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hits = [r["predicted"] for r in held if labels[r["doc_id"]]]
    false = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert len(hits) > 50 and np.mean(hits) > 0.75 and np.mean(false) < 0.02
