"""Suffix-array dedup: repeated strings of a fixed length by distributed prefix doubling.

Doubling ranks positions by the string of length 25, then 50, then 100 that starts there, each time by sorting pairs of
ranks at growing offsets, and drops positions whose rank is unique. Sorting every position of the corpus would move many times the
corpus, so the first round starts from sampled positions, without losing any:

* Every string of 100 bytes is represented by the position in it whose 25 bytes hash lowest (its anchor). Equal strings
  have equal anchors, so only anchors whose rank is shared need another look. One position in about 38 is an anchor.
* The strings of one anchor lie in one run, its context. Anchors of equal rank are ranked anew by their contexts: of
  equal contexts the first stays and the others are repeats through and through.
* What remains are first contexts that share an anchor with a different one. Spark sorts them by rank and
  position, and within each sorted stretch the positions themselves are ranked by doubling: pairs of ranks at offset 25,
  what is unique dropped, pairs at offset 50, and of equal ranks the first position stays.

Ranks are 64-bit names from hashes of the bytes, a context's rank being a pair of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BROADCAST_IDS, drop, keyed, release, renamed, sliced, with_ids, written
from sluice.operators.joins import join_back

LENGTH = 100
START = 25
SPAN = LENGTH - START + 1
#: Bytes that are worked on at a time; longer texts go in overlapping pieces.
PIECE = 1 << 20
#: Contexts of one rank, above which their positions are ranked by Spark instead of within one task.
HOT_CONTEXTS = 1000
#: How often the strings of a hot rank are halved before their positions are ranked one by one.
HALVINGS = 2
#: Bytes of contexts that a task ranks at a time, at least; a rank's contexts stay together.
STRETCH = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    return x * _U(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd number and of its inverse modulo 2^64."""
    table = np.random.default_rng(100).integers(0, 2**63, 256).astype(np.uint64) * _U(2) + _U(1)
    powers = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        x = np.full(2 * PIECE + 1, base, np.uint64)
        x[0] = 1
        powers.append(np.multiply.accumulate(x))
    return table, *powers


class Hashes:
    """Hashes of any stretches of a buffer, from sums of powers modulo 2^64."""

    def __init__(self, buffer: bytes) -> None:
        data = np.frombuffer(buffer, np.uint8)
        table, powers, self.inverse = _constants()
        if len(data) > 2 * PIECE:
            raise ValueError("too long")
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    done = 1
    while 2 * done <= span:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (span - done)], x[span - done :])


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to buffers of about PIECE bytes: buffer, and for each text in it its number, its offset within its
    text and its length. Texts that are too short hold no string and are left out."""
    held, number, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(0, len(text) - LENGTH + 1), PIECE - LENGTH + 1):
            part = text[lo : lo + PIECE]
            if size + len(part) > PIECE and held:
                yield b"".join(held), np.array(number), np.array(offset), np.array([len(p) for p in held])
                held, number, offset, size = [], [], [], 0
            held.append(part)
            number.append(i)
            offset.append(lo)
            size += len(part)
    if held:
        yield b"".join(held), np.array(number), np.array(offset), np.array([len(p) for p in held])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(rank, context, text, first, n): for each anchor the hash of its 25 bytes, the name of its context, the number of its
    text, the offset of the first string that it represents and the number of strings, which follow each other."""
    found = []
    for buffer, number, offset, size in pieces(texts):
        hashes = Hashes(buffer)
        h = hashes.all(START)
        # the position in the low bits: of equal hashes the leftmost is least
        least = _sliding_min((h & ~_U((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64), SPAN)
        n = size - LENGTH + 1
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), n)
        at = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(n) - n), n)
        anchor = (least[at] & _U((1 << 21) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.concatenate([new[1:], [len(at)]]) - 1
        first, end, place, own = at[new], at[last], anchor[new], owner[new]
        shape = _mix(((place - first).astype(np.uint64) << _U(32)) + (end - first).astype(np.uint64) + _U(1))
        found.append((h[place], hashes.of(first, end + LENGTH) ^ shape, number[own], first - begin[own] + offset[own], end - first + 1))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks and how often each row's rank occurs."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, count[rank]


def repeats(uid: np.ndarray, first: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(uid, position) of the strings of LENGTH bytes in ``contexts`` that also start earlier in them, by (uid, position).

    ``first``: the position of each context's first byte. Prefix doubling: ranks of 25 bytes from their hashes, of 50
    and of 100 from sorted pairs of ranks; strings whose rank has become unique are dropped.
    """
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(size)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + inner
    rank, count = _ranks(_hashes_in_pieces(contexts, size))
    alive = np.flatnonzero((count[at] > 1) & (count[at + START] > 1) & (count[at + 2 * START] > 1) & (count[at + 3 * START] > 1))
    if not len(alive):
        return uid[:0], first[:0]
    spot = np.unique(np.concatenate([at[alive], at[alive] + 2 * START]))
    double, count = _ranks(rank[spot].astype(np.int64) * len(rank) + rank[spot + START])
    a, b = np.searchsorted(spot, at[alive]), np.searchsorted(spot, at[alive] + 2 * START)
    more = (count[a] > 1) & (count[b] > 1)
    alive, a, b = alive[more], a[more], b[more]
    if not len(alive):
        return uid[:0], first[:0]
    whole, count = _ranks(double[a].astype(np.int64) * len(spot) + double[b])
    more = count > 1
    whole, alive = whole[more], alive[more]
    who, where = uid[row[alive]], first[row[alive]] + inner[alive]
    order = np.lexsort((where, who, whole))
    whole, who, where = whole[order], who[order], where[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], whole[1:] != whole[:-1]]), np.arange(len(whole)), 0))
    again = (who != who[lead]) | (where != where[lead])  # rows that are one text start a string at the same place
    return who[again], where[again]


def _hashes_in_pieces(contexts: list[bytes], size: np.ndarray) -> np.ndarray:
    """The hash of the 25 bytes at each position of the joined contexts; anything at a context's last 24."""
    out, lo = [], 0
    bounds = np.cumsum(size)
    while lo < len(contexts):
        hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + PIECE, "right")))
        buffer = b"".join(contexts[lo:hi])
        h = np.zeros(len(buffer), np.uint64)
        got = Hashes(buffer).all(START)
        h[: len(got)] = got
        out.append(h)
        lo = hi
    return np.concatenate(out)


def _distinct(uid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    new = np.concatenate([np.ones(min(1, len(uid)), bool), (uid[1:] != uid[:-1]) | (at[1:] != at[:-1])])
    return uid[new], at[new]


def runs(uid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring repeated strings as (uid, start, end) of the bytes that they cover."""
    uid, at = _distinct(uid, at)
    if not len(uid):
        return uid, at, at
    new = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return uid[new], at[new], at[last] + LENGTH


_SPANS = "uid long, start long, end long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rank, context, text, first, n = anchors([t.encode() for t in batch.column("text").to_pylist()])
        uid = batch.column("uid").to_numpy()[text] if len(text) else text
        yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(context.view(np.int64)), pa.array(uid), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int16))], names=["rank", "context", "uid", "first", "n"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, hot, uid, first, data = [], [], [], [], []
        for own, text, listed in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "listed")), strict=True):
            raw = text.encode()
            for x in listed:
                rank.append(x["rank"])
                hot.append(x["hot"])
                uid.append(own)
                first.append(x["first"])
                data.append(raw[x["first"] : x["first"] + x["n"] - 1 + LENGTH])
        columns = [pa.array(rank, pa.int64()), pa.array(hot, pa.bool_()), pa.array(uid, pa.int64()), pa.array(first, pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["rank", "hot", "uid", "first", "data"])


def _rank_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by rank; all contexts of a rank are ranked together."""

    def found(rows: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        uid, first = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        spans = runs(*repeats(uid, first, [c for r in rows for c in r[2]]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["uid", "start", "end"])

    held, size = [], 0
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        uid, first, data = batch.column("uid").to_numpy(), batch.column("first").to_numpy(), batch.column("data").to_pylist()
        lo = 0
        while lo < len(rank):
            if size >= STRETCH and rank[lo] != current:
                yield found(held)
                held, size = [], 0
            # up to the first change of rank after enough bytes, or to the end of the batch
            hi, more = lo, size
            while hi < len(rank) and (more < STRETCH or rank[hi] == (rank[hi - 1] if hi else current)):
                more += len(data[hi])
                hi += 1
            held.append((uid[lo:hi], first[lo:hi], data[lo:hi]))
            size, current, lo = more, rank[hi - 1], hi
    if held:
        yield found(held)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of hot ranks, halved. A string that starts l bytes before its anchor holds the bytes that all strings of l from a to b
    share; so equal strings are in halves of equal rank, the name of those bytes. ``whole`` names all bytes of the half."""
    names = ["rank", "whole", "uid", "first", "data", "off", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]

    def name(data: bytes, lo: int, hi: int) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=bytes((lo, hi))).digest(), "little", signed=True)

    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            some = batch.slice(lo, 4096)
            data, off = some.column("data").to_pylist(), some.column("off").to_numpy()
            if (off < 0).any():  # the anchor is the first place with its rank, of whose low bits the position took the place
                size = np.array([len(c) for c in data])
                h, rank = Hashes(b"".join(data)).all(START), np.repeat(some.column("rank").to_numpy().view(np.uint64), size)
                at, begin = np.flatnonzero(h >> _U(21) == rank[: len(h)] >> _U(21)), np.cumsum(size) - size
                off = at[np.searchsorted(at, begin)] - begin
            rows = []
            for uid, first, whole, far, a, b in zip(some.column("uid").to_pylist(), some.column("first").to_pylist(), data, off.tolist(), some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
                near = far - (len(whole) - LENGTH)
                middle = (a + b + 1) // 2
                for a_, b_ in ((a, middle - 1), (middle, b)):
                    least, most = max(near, a_), min(far, b_)
                    if least <= most:
                        part = whole[far - most : far - least + LENGTH]
                        rows.append((name(whole[far - a_ : far - b_ + LENGTH], a_, b_), name(part, least, most), uid, first + far - most, part, most, a_, b_))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _halved(hot: DataFrame, hot_contexts: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame, list[DataFrame]]:
    """(spans, contexts, hot, held) of hot contexts: what repeats a half through and through, the halves that share a rank with others,
    those whose rank is hot still, and the tables that all rest on. Halves that are alone with their rank repeat nothing."""
    spark = hot.sparkSession
    place, one = F.struct("uid", "first"), F.count(F.lit(1))
    spans, inside, held = [], [], []
    left = hot.select("rank", "uid", "first", "data", F.lit(-1).alias("off"), F.lit(0).alias("a"), F.lit(SPAN - 1).alias("b"))
    for _ in range(HALVINGS):
        halves = written(left.mapInArrow(_halves, "rank long, whole long, uid long, first long, data binary, off int, a int, b int"))
        firsts = written(halves.groupBy("rank", "whole").agg(one.alias("c"), F.min(place).alias("earliest")))
        ranks = written(firsts.groupBy("rank").agg(one.alias("c"), one.alias("n_firsts")))
        groups = written(join_back(firsts, ranks, ["rank"], _total(ranks)))
        rows = join_back(halves, groups, ["rank", "whole"], _total(groups)).withColumn("again", place != F.col("earliest"))
        rows = written(rows.where("again OR n_firsts > 1").drop("whole", "earliest"))
        drop(halves, firsts, ranks, groups)
        release(spark)
        held.append(rows)
        spans.append(rows.where("again").select("uid", F.col("first").alias("start"), (F.col("first") + F.octet_length("data")).alias("end")))
        inside.append(rows.where(~F.col("again") & (F.col("n_firsts") <= hot_contexts)).select("rank", "uid", "first", "data"))
        left = rows.where(~F.col("again") & (F.col("n_firsts") > hot_contexts))
        if left.isEmpty():
            break
    return spans, inside, left, held


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of hot contexts by their rank of 100, the pair (x, y) of ranks of 50 at offset 50: of a few thousand contexts
    the first of each rank with an empty end, and what repeats it as spans, already joined to runs."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            some = batch.slice(lo, 4096)
            data = some.column("data").to_pylist()
            size = np.array([len(c) for c in data])
            hashes = Hashes(b"".join(data))
            n, begin = size - LENGTH + 1, np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[row] + inner
            x, y = (hashes.of(at + k, at + k + LENGTH // 2).view(np.int64) for k in (0, LENGTH // 2))
            uid, where = some.column("uid").to_numpy()[row], some.column("first").to_numpy()[row] + inner
            order = np.lexsort((where, uid, y, x))
            x, y, uid, where = x[order], y[order], uid[order], where[order]
            leads = _leads(x, y)
            again = (uid != uid[leads]) | (where != where[leads])
            first = leads == np.arange(len(x))
            found = (*runs(uid[again], where[again]),)
            none = pa.nulls(len(found[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(v, pa.int64()) for v in found)], names=["x", "y", "uid", "start", "end"])
            yield pa.RecordBatch.from_arrays([*(pa.array(v[first]) for v in (x, y, uid, where)), pa.nulls(int(first.sum()), pa.int64())], names=["x", "y", "uid", "start", "end"])


def _leads(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of sorted pairs the number of the first row that is equal."""
    new = np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (x, y, uid, at): those that aren't the first of their rank."""
    last = None
    for batch in batches:
        x, y, uid, at = (batch.column(c).to_numpy() for c in ("x", "y", "uid", "at"))
        if not len(x):
            continue
        leads = _leads(x, y)
        lead_uid, lead_at = uid[leads], at[leads]
        if last is not None and last[:2] == (x[0], y[0]):  # the batch goes on with the rank of the one before
            lead_uid, lead_at = np.where(leads == 0, last[2], lead_uid), np.where(leads == 0, last[3], lead_at)
        last = x[-1], y[-1], lead_uid[-1], lead_at[-1]
        again = (uid != lead_uid) | (at != lead_at)  # rows that are one text start a string at the same place
        yield pa.RecordBatch.from_arrays([pa.array(uid[again]), pa.array(at[again])], names=["uid", "at"])


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = runs(batch.column("uid").to_numpy(), batch.column("at").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["uid", "start", "end"])


def repeated_spans(base: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(uid, spans): for each text with any, the bytes covered by strings that also start earlier, as sorted spans
    that may overlap or touch. ``base``: (uid, text) with unique uids whose order decides what is earlier.

    Ranks are counted by minima and maxima that are combined before the shuffle; ``join_back`` brings them back to the
    positions and deals out the rows of a very frequent rank. Hot contexts are halved first, so that few of them stay hot. Strings of those are
    joined with nothing: a few thousand contexts keep the first of each string, and what Spark sorts has it once for each of those. Tables are deleted as soon as the next one is written.
    """
    spark = base.sparkSession
    place, one = F.struct("uid", "first"), F.count(F.lit(1)).alias("c")
    found = base.select("uid", "text").mapInArrow(_find_anchors, "rank long, context long, uid long, first int, n short")
    shared = found.groupBy("rank").agg(one, F.min("context").alias("lo"), F.max("context").alias("hi"), F.min(place).alias("earliest")).where("c > 1")
    shared = written(shared)
    release(spark)
    rows = join_back(found, shared, ["rank"], _total(shared)).where((F.col("lo") < F.col("hi")) | (place != F.col("earliest")))
    rows = written(rows.select("rank", "context", "uid", "first", "n", (F.col("lo") < F.col("hi")).alias("mixed")))
    drop(shared)
    del found, shared
    release(spark)
    span = [F.col("uid"), F.col("first").cast("long").alias("start"), (F.col("first") + F.col("n") - 1 + LENGTH).cast("long").alias("end")]
    mixed = rows.where("mixed").drop("mixed")
    firsts = written(mixed.groupBy("rank", "context").agg(one, F.min(place).alias("earliest")))
    mixed = join_back(mixed, firsts, ["rank", "context"], _total(firsts)).withColumn("again", place != F.col("earliest"))
    mixed = written(mixed.select("rank", "uid", "first", "n", "again"))
    drop(firsts)
    firsts = mixed.where("NOT again")
    hot = written(firsts.groupBy("rank").agg(one).where(F.col("c") > hot_contexts).select("rank", F.lit(True).alias("hot")))
    some_hot = hot.count()
    firsts = firsts.join(F.broadcast(hot) if some_hot <= BROADCAST_IDS else hot, "rank", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    listed = written(firsts.groupBy("uid").agg(F.collect_list(F.struct("rank", "hot", "first", "n")).alias("listed")))
    release(spark)
    texts = with_ids(base.select("uid", "text"), listed.select("uid"), "uid", "left_semi")
    contexts = texts.join(listed, "uid").mapInArrow(_contexts, "rank long, hot boolean, uid long, first long, data binary")
    contexts = written(contexts)
    drop(listed, hot)
    release(spark)
    inside, held = contexts.where("NOT hot").drop("hot"), [rows, mixed, contexts]
    spans = rows.where("NOT mixed").select(*span).unionByName(mixed.where("again").select(*span))
    if some_hot:
        through, halves, left, tables = _halved(contexts.where("hot"), hot_contexts)
        spans, inside = reduce(DataFrame.unionByName, through, spans), reduce(DataFrame.unionByName, halves, inside)
        held += tables
    spans = spans.unionByName(inside.repartition("rank").sortWithinPartitions("rank", "uid", "first").mapInArrow(_rank_stretches, _SPANS))
    if some_hot and not left.isEmpty():
        strings = written(left.mapInArrow(_names, "x long, y long, uid long, start long, end long"))
        spans = spans.unionByName(strings.where("end IS NOT NULL").select("uid", "start", "end"))
        firsts_of = strings.where("end IS NULL").select("x", "y", "uid", F.col("start").alias("at"))
        later = firsts_of.repartition("x", "y").sortWithinPartitions("x", "y", "uid", "at").mapInArrow(_later, "uid long, at long")
        in_order = later.repartition("uid").sortWithinPartitions("uid", "at")  # so a text's strings join to few runs
        spans = spans.unionByName(in_order.mapInArrow(_join_runs, _SPANS))
        held.append(strings)
    out = written(spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    drop(*held)
    release(spark)
    return out


def _total(groups: DataFrame) -> int:
    return groups.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters of which they cover only a part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _with_spans(base: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts with spans, beside them, and those without, which need no shuffle."""
    ids = spans.select("uid")
    touched = with_ids(base, ids, "uid", "left_semi").join(spans, "uid")
    return touched, with_ids(base, ids, "uid", "left_anti")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row.

    A byte is removed if a string of 100 bytes that covers it also starts earlier, in a row of smaller doc_id or earlier in the same text.
    Null text counts as empty. Null ids come first. Rows of equal id are ordered by the SHA-256 of their texts, and
    rows equal in both are one text: neither is a repeat of the other. Further columns are ignored. No rows give an empty result.
    """
    base = keyed(docs, doc_id, text).select("uid", "key", "text")
    touched, rest = _with_spans(base, repeated_spans(base, hot_contexts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True):
                data, gone = value.encode(), merged(spans)
                rows.append((key, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    gone = touched.select("key", "text", "spans").mapInArrow(cut, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    whole = rest.select("key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return gone.unionByName(whole).withColumnRenamed("key", doc_id)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` and n_chars, where there is one, counted anew. Of a character that
    a repeat covers only in part nothing is cut; a text that is all repeats becomes empty and its row stays."""
    some, name = renamed(docs)
    rest = [c for n, c in name.items() if n not in ("doc_id", "text")]
    base = keyed(some, name["doc_id"], name["text"], tuple(rest))
    touched, whole = _with_spans(base, repeated_spans(base.select("uid", "text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = value.encode()
                texts.append(without(data, whole_characters(data, merged(spans))).decode())
            out = {c: batch.column(c) for c in ("key", *rest)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    columns = ["key", *rest, "text"]
    out = touched.select("key", *rest, "text", "spans").mapInArrow(cut, base.select(*columns).schema).unionByName(whole.select(*columns))
    back = {"doc_id": F.col("key").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in name:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[back.get(n, F.col(c)).alias(n) for n, c in name.items()])


def op5(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs)
