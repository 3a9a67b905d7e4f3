import re
from collections import defaultdict

import pytest

from sluice.llm import mixing, queries
from tests.llm.helpers import oracle, same_rows


def test_equals_oracle(spark, sf):
    same_rows(queries.op3_mixing(spark, sf), oracle(sf, mixing.ORACLE, "documents"))


@pytest.mark.parametrize("few", [True, False])
def test_budgets_ties_and_nulls(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = [(i, "w " * (i % 7), "s%d" % (i % 4) if i % 5 else None) for i in range(200)] + [(None, "a b c", "s0"), (None, None, "s0"), (3, "a b", "s3"), (3, "a b", "s3")]
    rows += [(1000, "one two three", "tiny")] + [(2000 + i, "", "void") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) < 3
    # water filling: those below their room share by weight
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1) * 9, strict=False))
    levels = {round(target[s] / weight[s], 6) for s in size if target[s] < 2 * size[s] - 1e-6}
    assert len(levels) == 1 and all(2 * size[s] <= max(levels) * weight[s] + 1e-6 for s in size if target[s] >= 2 * size[s] - 1e-6)
    again = {tuple(r) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {tuple(r) for r in got}


def test_prefix_sums(spark):
    rows = [("s", k * 2**50, i, i + 1) for i, k in enumerate([5, 3, 9, 3, 1000])]
    units = spark.createDataFrame(rows, "source string, key long, doc_id long, size long")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {r[2]: sum(x[3] for x in order[:i]) for i, r in enumerate(order)}
    for bits in (1, 4, 12):
        assert {r["doc_id"]: r["before"] for r in mixing.prefix_sums(units, bits).collect()} == want


def test_mixed_documents(spark):
    rows = [(i, "a b  c\nd " * (1 + i % 3), "en", "s%d" % (i % 2), 9 * (1 + i % 3)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == {d: n for d, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []
