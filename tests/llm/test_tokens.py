import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluice.llm import bpe, queries, token_counts
from sluice.llm.bpe_core import merger

BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
PIECES = ["a", "b", "the ", "Ñ", "É", "é", " ", "\n", "  ", "\t", "'s", "'S", "'LL", "1", "23", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "ß", "İ", "Σ", "日本", "\x1c", "\x85", "\xa0", "🙂", " ", "naïve", "x" * 70]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "ab" * 30_000]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(BYTE)
    words = {w.encode(): merger(BYTE).merge(w.encode()) for w in ("the", " the", "naïve", " b", "ab")}
    for lexicon in (None, bpe.Lexicon(bpe.compile_lexicon(words))):
        encoder = bpe.Encoder(BYTE, lexicon, size=64)
        encoder.AT_A_TIME = 5000
        some = texts(1500, 1)
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
            assert bpe.decode_ids(ids, encoder.model.token_bytes) == text


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): [rng.randrange(9) for _ in range(rng.randint(1, 3))] for _ in range(300)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    strange = [b"", b"abcabca", b"d", b"aaaaaaa"]
    assert all(lexicon.get(w) is None for w in strange)
    assert lexicon.get_many([*words, *strange]) == [np.array(x, "<u4").tobytes() for x in words.values()] + [None] * 4
    # as many states as there are different sets of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for x in words for p in (x[:i] for i in range(len(x) + 1))}
    assert lexicon.n_states == len(endings) and lexicon.n_words == len(words)
    empty = bpe.Lexicon(bpe.compile_lexicon({}))
    assert empty.get(b"a") is None and empty.n_words == 0


def test_counts_equal_the_library():
    library, model = Tokenizer.from_file(WORD), merger(WORD)
    known = {w: len(model.merge(w.encode())) for w in ("the", "naïve")}
    lengths = token_counts.stretch_lengths(model, token_counts.TableView(token_counts.compact_table(known)), 64)
    for text in texts(1500, 3):
        assert token_counts.count_text(text, lengths, token_counts.special_pattern(model)) == len(library.encode(text, add_special_tokens=False).ids), text


def test_queries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    one = {r["doc_id"]: r for r in queries.op1_bpe(spark, sf).collect()}
    ten = {r["doc_id"]: r for r in queries.op10_token_counts(spark, sf).collect()}
    assert len(one) == len(ten) == len(docs)
    for d in docs:
        ids = byte.encode(d["text"], add_special_tokens=False).ids
        r = one[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        r, n = ten[d["doc_id"]], len(word.encode(d["text"], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(d["text"].encode()), n > 2048)


@pytest.mark.parametrize("rows", [[], [(None, None, 1, "x"), (3, "", 2, None), (3, "", 2, None), (4, "the the\n", 5, "")]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert back.columns == ["doc_id", "n_tokens", "text"]
    assert sorted(map(str, back.collect())) == sorted(f"Row(doc_id={r[0]}, n_tokens={3 if r[1] else 0}, text={r[1] or ''!r})" for r in rows)
    assert sorted(map(str, bpe.encode(docs, BYTE, decoded="x").select("doc_id", "n_tokens", "x").toDF(*back.columns).collect())) == sorted(map(str, back.collect()))
    counts = token_counts.op10(docs, WORD).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(2 if r[1] else 0 for r in rows)
