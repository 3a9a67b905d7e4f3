import hashlib
import re
from collections import Counter
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, licenses, quality, queries
from sluice.llm.bpe_core import merger

BYTE = queries.tokenizer("byte_bpe_50k.json")


def slow_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ODD = ["", " ", "CC BY-NC by nc", "cc by nccc by nc", "under the MIT license. Under the mit License", "élicense under the mit license", "apache license version 20", "Apache License, Version 2.0 " * 500, "cc\x7fby_nc", "İcc by nc", "CC BY CC BY NC"]


def test_scan_text_equals_brute_force(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    for text in texts:
        found = licenses.scan_text(text)
        assert found[:5] == slow_scan(text), text
        assert set(filter(None, found[4].split(","))) <= set(filter(None, found[5].split(","))) and 0 <= found[6] <= 1
    assert any(licenses.scan_text(t)[1] for t in texts)


@pytest.mark.parametrize(
    "expression, labels, demand",
    [
        ("MIT", "mit", 0.2),
        ("MIT OR GPL-3.0-only", "gpl-3,mit", 0.2),
        ("MIT and GPL-2.0-or-later", "gpl-2,mit", 0.8),
        ("(MIT OR GPL-2.0) AND Apache-2.0", "apache-2,gpl-2,mit", 0.2),
        ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", "cc-by-nc,gpl-2,mit", 0.2),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "gpl-2-with-classpath-exception-2,mit", 0.5),
        ("LicenseRef-Own", "licenseref-own", 0.6),
    ],
)
def test_expressions(expression, labels, demand):
    found, value = licenses.evaluate(expression)
    assert (",".join(sorted(found)), value) == (labels, demand)


@pytest.mark.parametrize("bad", ["", "AND", "MIT OR", "(MIT", "MIT)", "MIT MIT", "(MIT OR BSD) WITH x", "MIT ~ BSD"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


def test_tags():
    assert licenses.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause */ rest")[5] == "bsd-3-clause,gpl-2,mit"
    assert licenses.scan_text("SPDX-License-Identifier: MIT is what we chose")[5:] == ("mit", 0.2)
    assert licenses.scan_text("SPDX-License-Identifier: )(")[5:] == ("unknown", licenses.UNKNOWN)
    assert licenses.scan_text("spdx license identifier without a colon")[5:] == ("", 0.0)


def test_every_tag_of_a_line_is_read_to_its_end():
    one_line = "/* SPDX-License-Identifier: MIT */ f(); /* SPDX-License-Identifier: GPL-3.0-only */ SPDX-License-Identifier: ISC SPDX-License-Identifier: Zlib"
    assert licenses.scan_text(one_line)[5:] == ("gpl-3,isc,mit,zlib", 0.8)
    long = " AND ".join(f"LicenseRef-{i}" for i in range(20_000))
    found, value = licenses.tagged(f"SPDX-License-Identifier: {long} AND CC-BY-NC-4.0 is what we chose")[0]
    assert len(found) == 20_001 and "cc-by-nc" in found and value == 1.0
    assert licenses.tagged("SPDX-License-Identifier: " + "MIT OR (" * 20_000) == [(frozenset({"mit"}), 0.2)]


def test_longest_readable_beginning():
    words = ["MIT", "GPL-2.0", "(ISC", "Zlib)", "or", "AND", "with", "x,", ")"]
    for seed in range(3000):
        some = [words[(seed * 7919 + k * k * 31 + seed // (k + 1)) % len(words)] for k in range(1 + seed % 7)]
        want = (frozenset({"unknown"}), licenses.UNKNOWN)
        for n in range(len(some), 0, -1):
            try:
                want = licenses.evaluate(" ".join(some[:n]))
                break
            except ValueError:
                continue
        assert licenses.tagged("SPDX-License-Identifier: " + " ".join(some) + " ~") == [want]


def test_scan_of_odd_tables(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "CC BY-NC", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["base_labels"]) for r in licenses.license_scan(docs).collect())
    assert got == [(0, 0, 0, None, ""), (1, 0, 0, None, ""), (1, 0, 0, None, ""), (2, 3, 1, 0, "cc-by-nc")]
    assert licenses.license_scan(docs.limit(0)).collect() == []


def slow_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.op7(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == slow_quality(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = {r["doc_id"]: r["kept"] for r in got if not r["base_failed"]}
    assert all(kept[d] for d in good if d in kept)
    assert sum(kept.get(d, False) for d in bad) < 0.6 * len(bad)


def test_quality_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "good word"), (2, "bad word"), (3, None), (3, " \n\x0b"), (None, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["n_words"]): r["score"] for r in quality.quality(docs, labels, buckets=1 << 12).collect()}
    a, b = 0.5, 1 << 12
    norm = log(7 + a * b) - log(3 + a * b)  # seven words and pairs in all, three of them in the trusted text
    word, only, other = norm + log(1 + a) - log(3 + a), norm + log(1 + a) - log(1 + a), norm + log(a) - log(1 + a)
    assert got[(1, 2)] == pytest.approx((2 * only + word) / 3, abs=1e-5)
    assert got[(2, 2)] == pytest.approx((2 * other + word) / 3, abs=1e-5)
    assert got[(None, 1)] == pytest.approx(word, abs=1e-5) and got[(3, 0)] == 0
    assert quality.op7(docs.limit(0), labels.limit(0)).collect() == []


def test_chat_equals_sql_and_text(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: r for r in con.sql(chat.ORACLE).fetchall()}
    got = {r["conv_id"]: tuple(r) for r in queries.op9_chat(spark, sf).collect()}
    assert got == want and -7 in got


def test_chat_round_trip(spark):
    nasty = "\x1b<s></s>[INST]\x1ba[/INST]<|endoftext|> \n\n[IN[INST]ST]日🙂 "
    rows = [(1, 1, "assistant", nasty), (1, 0, "us\ner", nasty), (1, 1, "assistant", nasty), (2, None, None, None), (None, 3, "assistant", ""), (None, 4, "assistant", "!"), (None, 4, "assistant", "!"), (3, 0, "assistant", "(see) Hello."), (3, 1, "user", "x"), (3, 2, "assistant", '"Hi"')]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    every = chat.format_chats(table, BYTE).collect()
    chats = {r["conv_id"]: r for r in every}
    assert chat.parse(chats[1]["formatted"]) == [("us\ner", nasty), ("assistant", nasty), ("assistant", nasty)]
    assert chat.parse(chats[2]["formatted"]) == [("", "")]
    token_bytes = merger(BYTE).token_bytes
    loss = lambda r: chat.masked_text(r["ids"], [tuple(m) for m in r["mask"]], token_bytes)
    assert loss(chats[1]) == nasty * 2 and loss(chats[3]) == '(see) Hello."Hi"'
    assert sorted(loss(r) for r in every if r["conv_id"] is None) == ["", "!", "!"]
    assert chats[1]["ids"] == chat.tokenizer(BYTE).encode(chats[1]["formatted"], add_special_tokens=False).ids
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table, BYTE), BYTE).collect()}
    assert digest[1]["loss_sha256"] == hashlib.sha256((nasty * 2).encode()).hexdigest() and digest[1]["loss_chars"] == 2 * len(nasty)
    wider = F.transform("mask", lambda m: F.struct(m["first"].alias("first"), (m["last"] - 1).alias("last")))
    wrong = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table, BYTE).where("conv_id = 3").withColumn("mask", wider), BYTE).collect()}
    assert wrong[3]["loss_sha256"] != digest[3]["loss_sha256"] and wrong[3]["turns_sha256"] == digest[3]["turns_sha256"]
    assert chat.format_chats(table.limit(0), BYTE).collect() == []


def test_masks_lie_on_the_edges_of_turns():
    library = chat.tokenizer(BYTE)
    for text in ("Hello.", '"Hello there"', "(see)", ">", "</", " x ", "\n\n", "é", "🙂🙂", "<|endoftext|>", "x" * 100_000):
        formatted, spans = chat.render([("user", text), ("assistant", text), ("assistant", ""), ("assistant", text)])
        code = library.encode(formatted, add_special_tokens=False)
        (a, b), (c, d) = chat.loss_mask(code.offsets, spans)
        for first, last, span in ((a, b, spans[0]), (c, d, spans[2])):
            assert (code.offsets[first][0], code.offsets[last - 1][1]) == span
            assert [code.tokens[first - 1], code.tokens[last]] == ["<s>", "</s>"]
    with pytest.raises(ValueError):
        chat.loss_mask([(0, 2), (2, 5)], [(1, 5)])


def test_long_conversation(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"word {i} " * 50) for i in range(4000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    r = chat.digests(chat.format_chats(table, BYTE), BYTE).where("conv_id = 5").first()
    assert r["n_turns"] == 4000 and r["loss_sha256"] == hashlib.sha256("".join(t for _, _, who, t in rows if who == "assistant").encode()).hexdigest()
