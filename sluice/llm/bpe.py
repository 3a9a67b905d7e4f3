"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' frequent words (counted over all documents, a bounded number kept) are compiled, with their token ids as
outputs, into a shared-suffix automaton: words with equal endings share states, and each arc carries how many words
sort before it, so that the sum along a path is the word's number and leads to its ids. The file reaches every executor once and
is memory-mapped there by all its Python workers. Words that the automaton lacks are merged exactly, pair by pair, and
kept in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bpe_core import SPACES, IntTable, batch_merger, merger
from sluice.llm.common import frequent_words, shared_file, sliced

LEXICON_WORDS = 32_768
CACHE_WORDS = 150_000

#: Fixed value: the split pattern of byte-level vocabularies such as byte_bpe_50k.json.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Where text can't be cut before every blank without looking at its neighbours.
_RUNS = re.compile(r"  | \n|\n |[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_MAGIC = b"MATL"


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of ``entries``' keys, built incrementally from sorted words, with their ids.

    Layout: magic, numbers of states, arcs, words, ids and slots; first arc of each state, arcs' targets and outputs, first id
    of each word, ids, is-final flag of each state, arcs' labels; and, for following many arcs at a time, a hash table of
    (state, label) with the arcs. An arc's output is the number of words that sort before every word through it, counted from its state.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states: final, finished arcs; the last arc of each is still open
    last = b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            final, arcs = path.pop()
            node = (final, tuple(arcs))
            if node not in register:
                register[node] = len(states)
                states.append(node)
            path[-1][1].append((last[len(path) - 1], register[node]))

    for word in words:
        same = len(os.path.commonprefix([last, word]))
        close(same)
        last = word
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
    close(0)
    states.append((path[0][0], tuple(path[0][1])))

    below = []  # words that end in or after each state; targets come before sources
    first, labels, targets, outputs = [0], bytearray(), [], []
    for final, arcs in states:
        n = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(n)
            n += below[target]
        below.append(n)
        first.append(len(targets))
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) if ids else np.zeros(1)
    flat = np.fromiter((i for x in ids for i in x), "<u4")
    owner = np.repeat(np.arange(len(states)), np.diff(first)).astype(np.uint64)
    arcs = IntTable.build(owner << np.uint64(8) | np.frombuffer(bytes(labels), np.uint8).astype(np.uint64), np.arange(len(targets)))
    head = _MAGIC + struct.pack("<5I", len(states), len(targets), len(words), len(flat), len(arcs.keys))
    ints = [np.asarray(x, "<u4").tobytes() for x in (first, targets, outputs, starts)]
    body = b"".join([head, *ints, flat.tobytes(), bytes(int(f) for f, _ in states), bytes(labels)])
    return body + bytes(-len(body) % 8) + arcs.keys.astype("<u8").tobytes() + arcs.values.astype("<i8").tobytes()


class Lexicon:
    """Reads a compiled lexicon where it lies; nothing is copied."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        view = memoryview(data)
        if bytes(view[:4]) != _MAGIC:
            raise ValueError("not a lexicon")
        n_states, n_arcs, n_words, n_ids, slots = struct.unpack("<5I", view[4:24])
        at, self._data = 24, data
        ints = []
        for n in (n_states + 1, n_arcs, n_arcs, n_words + 1, n_ids):
            ints.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._targets, self._outputs, self._starts, self._ids = ints
        self._final, self._labels, self._root = at, at + n_states, n_states - 1
        self.n_states, self.n_words = n_states, n_words
        at += n_states + n_arcs
        at += -at % 8
        self._arcs = IntTable(*(np.frombuffer(data, t, slots, at + 8 * slots * i) for i, t in enumerate(("<u8", "<i8"))))

    def get(self, word: bytes) -> list[int] | None:
        first, find, labels = self._first, self._data.find, self._labels
        state, number = self._root, 0
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            number += self._outputs[arc]
            state = self._targets[arc]
        if not self._data[self._final + state] or not word:
            return None
        return self._ids[self._starts[number] : self._starts[number + 1]].tolist()


    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit integers, None for words that aren't in the lexicon."""
        out: list[bytes | None] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        who = np.flatnonzero(size)
        state, number = np.full(len(who), self._root, np.int64), np.zeros(len(who), np.int64)
        targets, outputs, starts = (np.asarray(x) for x in (self._targets, self._outputs, self._starts))
        ids = memoryview(self._ids).cast("B")
        step = 0
        while len(who):
            arc = self._arcs.get(state.astype(np.uint64) << np.uint64(8) | data[begin[who] + step].astype(np.uint64), -1)
            on = arc >= 0
            who, arc, number = who[on], arc[on], number[on]
            number, state = number + outputs[arc], targets[arc].astype(np.int64)
            step += 1
            for k in np.flatnonzero(size[who] == step).tolist():
                if self._data[self._final + int(state[k])]:
                    n = int(number[k])
                    out[who[k]] = bytes(ids[4 * int(starts[n]) : 4 * int(starts[n + 1])])
            more = size[who] > step
            who, state, number = who[more], state[more], number[more]
        return out


@lru_cache(2)
def mapped(name: str) -> Lexicon:
    """The lexicon file ``name`` among the files that Spark has brought to this machine."""
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers; equal to the library's encoding of each text alone.

    What is missing in the caches is looked up in the lexicon, and then merged, for many texts at a time. A cache that
    is full makes room before the next texts: what was in use lately stays.
    """

    #: Characters whose pre-tokens are gathered at a time.
    AT_A_TIME = 500_000
    #: Longer words and stretches are forgotten after their texts, so that the caches' entries are small.
    LONGEST = 64

    def __init__(self, path: str, lexicon: Lexicon | None = None, size: int = CACHE_WORDS) -> None:
        self.model, self.merger, self.lexicon, self.size = merger(path), batch_merger(path), lexicon, size
        self.special = re.compile("(" + ("|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) or r"(?!)") + ")")
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _resolve(self, words: list[str]) -> list[bytes]:
        """By the lexicon, and what it lacks by merging."""
        data = [w.encode() for w in words]
        found = self.lexicon.get_many(data) if self.lexicon else [None] * len(data)
        unseen = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(unseen, self.merger.merge([data[i] for i in unseen]), strict=True):
            found[i] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= self.AT_A_TIME):
                chars += len(texts[hi])
                hi += 1
            out += self._encode(texts[lo:hi])
            lo = hi
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.size or len(self.stretches) > self.size:
            self.old, self.words, self.stretches = (self.words, self.stretches), {}, {}
        # each piece of a text: an id, a list of words, or (first words, stretches that follow a blank each)
        plans: list[list] = []
        words: set[str] = set()
        wanted: set[str] = set()
        for text in texts:
            plan = []
            for i, piece in enumerate(self.special.split(text) if "<|" in text else [text]):
                if i % 2:
                    plan.append(struct.pack("<I", self.model.special[piece]))
                elif _RUNS.search(piece):
                    plan.append((SPLIT.findall(piece), []))
                else:
                    # the only white space is single blanks and line breaks: no pre-token crosses the place before a blank
                    head, *rest = piece.split(" ")
                    plan.append((SPLIT.findall(head), rest))
                    wanted.update(rest)
                if not i % 2:
                    words.update(plan[-1][0])
            plans.append(plan)
        wanted.difference_update(self.stretches)
        known = self.old[1]
        missing = [x for x in wanted if x not in known]
        self.stretches.update((x, known[x]) for x in wanted if x in known)
        # a stretch of letters is a pre-token with the blank before it, and most others are one with a mark after it
        plain = [x for x in missing if x.isalpha()]
        parts = {x: [" " + x[:-1], x[-1]] if x[:-1].isalpha() and x[-1] in ".,;:!?" else SPLIT.findall(" " + x) for x in missing if not x.isalpha()}
        words.update(chain.from_iterable(parts.values()))
        self.stretches.update(zip(plain, self._resolve([" " + x for x in plain]), strict=True))
        cache, older = self.words, self.old[0]
        words.difference_update(cache)
        cache.update((x, older[x]) for x in words if x in older)
        rest = [x for x in words if x not in older]
        cache.update(zip(rest, self._resolve(rest), strict=True))
        get, follow = cache.__getitem__, self.stretches.__getitem__
        for stretch, found in parts.items():
            self.stretches[stretch] = b"".join(map(get, found))
        out = [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p[0])) + b"".join(map(follow, p[1])) for p in plan) for plan in plans]
        for held, new in ((cache, rest), (self.stretches, missing)):
            for x in new:
                if len(x) > self.LONGEST:
                    del held[x]
        return out


def decode_ids(ids: bytes, token_bytes: list[bytes]) -> str:
    return b"".join(map(token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def ship_lexicon(docs: DataFrame, path: str, text: str, words: int) -> str:
    """Builds the lexicon for ``docs`` and gives the name under which every executor finds it."""
    model = merger(path)
    entries = {}
    for word in frequent_words(docs, words, text):
        for form in (word, " " + word):
            if SPLIT.findall(form) == [form]:
                entries[form.encode()] = model.merge(form.encode())
    data = compile_lexicon(entries)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    context = docs.sparkSession.sparkContext
    if not any(known.rpartition("/")[2] == name for known in context.listFiles):  # a name stands for one content
        context.addFile(shared_file(docs.sparkSession, name, data))
    return name


def encode(docs: DataFrame, path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned 32-bit integers) in place of
    ``text``, one row for each row, as the tokenizers library encodes each whole text with add_special_tokens=False.
    ``decoded`` names one more column: what the ids decode to, as ``decode`` gives it, in the same pass.

    Null text counts as empty: no ids. Other columns pass through; columns named n_tokens or ids are replaced. Rows
    are independent, so null keys, ties and repeated rows need no rule, and an empty table gives an empty result.
    ``path`` is the vocabulary file, readable at the same place on every executor.
    """
    name = ship_lexicon(docs, path, text, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, mapped(name))
        for batch in sliced(batches):
            ids = encoder.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [*batch.columns[:-1], counts, pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([decode_ids(x, encoder.model.token_bytes) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    added = ["n_tokens", "ids", *([decoded] if decoded else [])]
    kept = [f for f in docs.schema.fields if f.name not in (text, *added)]
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(text).cast("string").alias("text"))
    types = [*(f.dataType.simpleString() for f in kept), "long", "binary", *(["string"] if decoded else [])]
    return inner.mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(types))).toDF(*[f.name for f in kept], *added)


def decode(encoded: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encoded`` (of ``encode``) with ``text`` in place of ``ids``: the tokens' bytes, read as UTF-8, what isn't
    UTF-8 replaced, special tokens kept. Null ids give null; ids outside the vocabulary raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = merger(path).token_bytes
        for batch in sliced(batches):
            texts = [None if x is None else decode_ids(x, token_bytes) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    kept = [f for f in encoded.schema.fields if f.name not in ("ids", text)]
    inner = encoded.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col("ids").alias("ids"))
    types = [*(f.dataType.simpleString() for f in kept), "string"]
    return inner.mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(types))).toDF(*[f.name for f in kept], text)


def op1(docs: DataFrame, path: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
