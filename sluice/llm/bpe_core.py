"""Exact byte-pair merging for the vocabulary files of the ``tokenizers`` library (JSON, byte-level BPE)."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: Unicode White_Space, as the tokenizers' ``\s`` has it; the inside of a character class.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: Latin-1's visible characters stand for
    themselves, the other bytes for code points from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(rest)) for b in range(256)]


class Merger:
    """Merges the bytes of one pre-token into ids.

    ``pairs`` maps (left id, right id), packed into one integer, to (rank, merged id), packed as well.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        alphabet, end = byte_alphabet(), model.get("end_of_word_suffix") or ""
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in (token.removesuffix(end) if end else token))
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        if not word:
            return []
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        """Repeatedly the best pair, leftmost first; quadratic, and quickest for usual words."""
        get, none = self.pairs.get, 1 << 62
        while len(ids) > 1:
            found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            ids[at : at + 2] = [best & 0xFFFFF]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap over a linked list: n log n, for pre-tokens of any length."""
        get, n = self.pairs.get, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(v >> 20, i, v & 0xFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (v := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (v >> 20, x, v & 0xFFFFF, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class IntTable:
    """Open addressing over 64-bit keys, for looking up many at a time; at most an eighth full, so probes are few."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - (len(keys).bit_length() - 1))

    #: No key: keys are packed pairs below 2^60.
    EMPTY = np.uint64(2**64 - 1)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> IntTable:
        size = 1 << max(4, (8 * len(keys)).bit_length())
        table = cls(np.full(size, cls.EMPTY), np.zeros(size, np.int64))
        left, at = np.arange(len(keys)), table._home(keys)
        while len(left):
            free = table.keys[at] == cls.EMPTY
            spot, first = np.unique(at[free], return_index=True)  # one key for each free slot
            put = np.flatnonzero(free)[first]
            table.keys[spot], table.values[spot] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) % size
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._home(keys)
        out = np.full(len(keys), default, np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (held != self.EMPTY)
            left, at = left[more], (at[more] + 1) % len(self.keys)
        return out


class BatchMerger:
    """The merges of ``Merger`` for many pre-tokens at a time, in step: every round merges the best pair, leftmost first, of each."""

    LONGEST = 32
    NONE = 1 << 62

    def __init__(self, model: Merger) -> None:
        self.model = model
        self.first, self.last = np.array(model.first, np.int64), np.array(model.last, np.int64)
        self.pairs = IntTable.build(np.fromiter(model.pairs, np.uint64, len(model.pairs)), np.fromiter(model.pairs.values(), np.int64, len(model.pairs)))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.get((a << 20 | b).astype(np.uint64), self.NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, word in enumerate(words):
            if 0 < len(word) <= self.LONGEST:
                short.append(i)
            elif word:
                out[i] = np.array(self.model.merge(word), "<u4").tobytes()
        if not short:
            return out
        size = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        data = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        begin, width = np.cumsum(size) - size, int(size.max())
        cols = np.arange(width)
        inside = cols < size[:, None]
        ids = self.first[data[np.where(inside, begin[:, None] + cols, 0)]]
        rows = np.arange(len(short))
        ids[rows, size - 1] = self.last[data[begin + size - 1]]
        pair = np.full((len(short), max(1, width - 1)), self.NONE, np.int64)
        r, c = np.nonzero(inside[:, 1:])
        pair[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        done, count, who = ids.copy(), size.copy(), rows
        while len(who):
            at = pair.argmin(axis=1)
            best = pair[np.arange(len(who)), at]
            ended = best == self.NONE
            if ended.any():
                done[who[ended], : ids.shape[1]] = ids[ended]
                count[who[ended]] = size[ended]
                going = ~ended
                ids, pair, size, who, at, best = ids[going], pair[going], size[going], who[going], at[going], best[going]
                if not len(who):
                    break
            rows = np.arange(len(who))
            ids[rows, at] = best & 0xFFFFF
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = np.arange(max(1, pair.shape[1] - 1))
            if pair.shape[1] > 1:
                pair = np.take_along_axis(pair, cols + (cols >= at[:, None]), axis=1)
            size = size - 1
            for spot in (at - 1, at):
                held = (spot >= 0) & (spot < pair.shape[1])
                fits = held & (spot < size - 1)
                pair[rows[held], spot[held]] = self.NONE
                pair[rows[fits], spot[fits]] = self._rank(ids[rows[fits], spot[fits]], ids[rows[fits], spot[fits] + 1])
        raw = done[np.arange(done.shape[1]) < count[:, None]].astype("<u4").tobytes()
        end = (4 * np.cumsum(count)).tolist()
        start = 0
        for i, stop in zip(short, end, strict=True):
            out[i] = raw[start:stop]
            start = stop
        return out


@lru_cache(4)
def batch_merger(path: str) -> BatchMerger:
    return BatchMerger(merger(path))


@lru_cache(4)
def merger(path: str) -> Merger:
    """One per process and vocabulary."""
    return Merger(path)
