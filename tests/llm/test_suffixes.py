import hashlib

import numpy as np
import pytest

from sluice.llm import queries, suffixes


def brute(rows):
    """By a set of all strings of 100 bytes; rows equal in id and text are one."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 99):
            string = data[i : i + 100]
            if string in seen:
                gone[i : i + 100] = True
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[key, text] = (str(key), len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(data) > 0 and gone[0])), hashlib.sha256(kept).hexdigest())
    return sorted(out[r] for r in rows)


def got(df):
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in df.collect())


def sample(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(n))
    passages = [word(n) for n in (22, 30, 60, 200)]
    texts = []
    for i in range(40):
        parts = [word(rng.integers(0, 50))]
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, len(p) // 2)
            parts += [p[a:] if rng.random() < 0.5 else p, word(rng.integers(0, 30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1][:-3] + "zzz", "a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 300, "", None, "é" * 120, "xé" + "é" * 120, word(300) * 3]
    return [(i * 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [suffixes.HOT_CONTEXTS, 1])
@pytest.mark.parametrize("piece", [suffixes.PIECE, 400])
def test_equals_brute_force(spark, hot, piece, monkeypatch):
    rows = sample()
    if piece == 400:  # pieces, stretches and filters in one process
        texts = [(t or "").encode() for _, t in rows]
        whole = suffixes.anchors(texts)
        monkeypatch.setattr(suffixes, "PIECE", 400)
        parts = suffixes.anchors(texts)
        assert parts[4].sum() == whole[4].sum() == sum(max(0, len(t) - 99) for t in texts) and len(parts[0]) > len(whole[0])
        return
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(suffixes.suffix_dedup(docs, hot_contexts=hot)) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = sample(9)[:14]
    rows += [(2, rows[5][1]), (2, rows[5][1]), (None, rows[7][1]), (None, None), rows[3]]
    assert got(suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert suffixes.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op5_suffixes(spark, sf)) == brute(rows)


def test_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(12)
    body = rng.integers(97, 123, suffixes.PIECE + 150_000).astype(np.uint8).tobytes().decode()
    passage = body[500:700]
    rows = [(1, body + passage + body[: 2 * suffixes.PIECE // 1000] + "é"), (2, body[-90_000:]), (3, "short"), (4, "q" + passage[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.suffix_dedup(docs)) == brute(rows)


def test_stretches_and_doubling():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    data = [bytes(rng.choice(list(b"xy"), 3)) + b"q" * rng.integers(95, 130) + bytes(rng.choice(list(b"xy"), 2)) for _ in range(300)]
    uid = np.arange(300) // 3
    first = np.arange(300) % 3 * 1000
    want, seen = set(), set()
    for u, f, d in sorted(zip(uid, first, data, strict=True), key=lambda r: (r[0], r[1])):
        for i in range(len(d) - 99):
            if d[i : i + 100] in seen:
                want.add((int(u), int(f) + i))
            seen.add(d[i : i + 100])
    assert set(zip(*(x.tolist() for x in suffixes.repeats(uid, first, data)), strict=True)) == want
    # the same from a stream of batches, each rank's rows together
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(c), np.int64)), pa.array(uid[c]), pa.array(first[c]), pa.array([data[i] for i in c], pa.binary())], names=["rank", "uid", "first", "data"]) for c in np.array_split(np.arange(300), 7)]
    spans = [s for b in suffixes._rank_stretches(iter(batches)) for s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {(u, i) for u, a, b in spans for i in range(a, b - 99)} == want


def test_deduplicated_cuts_whole_characters(spark):
    rows = [(1, "s", "é" + "b" * 120, 0), (2, "t", "è" + "b" * 120 + "!", 0), (3, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int")
    out = sorted(map(tuple, suffixes.deduplicated(docs).collect()))
    assert out == [(1, "s", "é" + "b" * 21, 22), (2, "t", "è!", 2), (3, None, "", 0)] or out[1] == (2, "t", "è!", 2)
    assert suffixes.deduplicated(docs).columns == docs.columns and suffixes.deduplicated(docs.limit(0)).collect() == []


def test_hot_strings_are_sorted_and_not_joined(spark, monkeypatch):
    """Of the strings of hot contexts only the first of some thousand contexts goes on, and no join carries them all."""
    joined, whole = [], suffixes.join_back
    monkeypatch.setattr(suffixes, "join_back", lambda rows, groups, keys, *more: joined.append(keys) or whole(rows, groups, keys, *more))
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh "), 160))
    rows = [(i, "".join(rng.choice(list("abcdefgh"), 30)) + passage[i % 7 :] + "".join(rng.choice(list("abcdefgh"), 30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(suffixes.suffix_dedup(docs, hot_contexts=1)) == brute(rows)
    assert joined and ["x", "y"] not in joined


def test_later_strings_over_batches():
    import pyarrow as pa

    rows = sorted({(x, y, u, a) for x, y, u, a in np.random.default_rng(7).integers(0, 4, (200, 4)).tolist()})
    rows = sorted(rows + rows[:9])
    names = ["x", "y", "uid", "at"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 5], strict=True)], names=names) for i in range(0, len(rows), 5)]
    out = [r for b in suffixes._later(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    first = {}
    for r in rows:
        first.setdefault(r[:2], r[2:])
    assert out == [r[2:] for r in rows if r[2:] != first[r[:2]]]


def test_hot_contexts_that_share_a_few_words_name_no_string(spark, monkeypatch):
    written, tables = suffixes.written, []
    monkeypatch.setattr(suffixes, "written", lambda df: tables.append(df.columns) or written(df))
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    common = "words that very many texts hold"
    rows = [(i, f"{word(20)} {common} {word(20)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffixes.suffix_dedup(docs, hot_contexts=30)) == brute(rows)
    assert any("whole" in t for t in tables) and not any("x" in t for t in tables)
