import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import mixing, quality, queries
from tests.llm import test_minhash, test_suffixes, test_text_rules


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    inputs, outputs = [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([r.asDict() for r in docs.collect()])
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outputs.append([r.asDict() for r in docs.collect()])
        assert docs.columns == columns or i == 4
    by = [{r["doc_id"]: r for r in x} for x in inputs]

    scores = {r["doc_id"]: r["score"] for r in quality.op7(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    want = {d for d, r in by[0].items() if not test_text_rules.slow_quality(r["text"])[5] and scores[d] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in outputs[0]} == want and outputs[0] == [by[0][r["doc_id"]] for r in outputs[0]]

    groups = test_minhash.brute([(d, r["text"]) for d, r in by[1].items()], 5, 80)
    assert sorted(str(r["doc_id"]) for r in outputs[1]) == sorted(d for d, _, c in groups if d == c)

    cut = {r[0]: r for r in test_suffixes.brute([(d, r["text"]) for d, r in by[2].items()])}
    for r in outputs[2]:
        n = cut[str(r["doc_id"])]
        left = r["text"].encode()
        assert n[1] - n[2] <= len(left) <= n[1] - n[2] + 6 * n[3] and r["n_chars"] == len(r["text"])
        assert n[2] and len(left) > n[1] - n[2] or hashlib.sha256(left).hexdigest() == n[4]

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    got = defaultdict(int)
    for r in outputs[3]:
        got[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
        assert by[3][r["doc_id"]]["text"].startswith(r["text"])
    assert got == {d: n for d, n in taken.items() if n}

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], np.asarray(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in inputs[4])
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in outputs[4]) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in outputs[4])

    whole = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in outputs[4])


def test_near_duplicates_go_by_row(spark, sf):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [
        (1, a, "en", "s", 1), (7, a + " more", "en", "s", 2), (7, b, "en", "s", 3),  # the copy goes, the other row of its id stays
        (9, c, "en", "s", 5), (9, c, "en", "s", 4), (12, c + " more", "en", "s", 6), (9, c + " less", "en", "s", 7),  # one of them stays
        (None, d, "en", "s", 8), (None, d, "en", "s", 9), (None, d + " more", "en", "s", 10),
        (None, e, "en", "s", 11), (3, e, "en", "s", 12), (4, f, None, None, None), (5, "", None, None, None), (6, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    done = corpus_pipeline.near_duplicates(spark, docs, sf)
    got = [tuple(r) for r in done.collect()]
    assert done.columns == docs.columns and set(got) <= set(rows) and len(got) == 8
    groups = [[(x[0], x[1][:1]) for x in got if (x[1] or "").startswith(p)] for p in "abcdef"]
    assert groups == [[(1, "a")], [(7, "b")], [(9, "c")], [(None, "d")], [(3, "e")], [(4, "f")]]
    assert (9, c, "en", "s", 5) not in got and (5, "", None, None, None) in got and (6, None, None, None, None) in got


CLASHES = ("uid", "key", "digest", "size", "source_size", "target", "taken", "score", "n_words", "kept", "spans", "n", "one", "block", "c1", "_source", "_key", "_text", "_id", "label")


def test_columns_of_any_name_pass_through(spark, sf):
    prose = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(30).collect()]
    rows = [(i % 29 if i != 7 else None, t, "en", f"s{i % 2}", len(t), *(f"{c}-{i}" for c in CLASHES)) for i, t in enumerate(prose)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    known = {r[5:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        done = stage(spark, docs, sf)
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
        found = done.collect()
        assert found and {tuple(r)[5:] for r in found} <= known
        assert all(r["lang"] == "en" and r["source"] in ("s0", "s1") for r in found)
        docs = spark.createDataFrame(found, docs.schema)


def test_odd_rows_and_empty_tables(spark, sf):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " x", None, None, None), (None, None, None, None, None), (2, "", "", "", 0), (3, text, "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        n = []
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, some, sf)
            some = spark.createDataFrame(done.collect(), done.schema)
            n.append(some.count())
        assert n[0] in (4, 0) and n[-1] <= n[0] * 2
