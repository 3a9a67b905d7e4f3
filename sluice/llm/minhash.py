"""MinHash near-dedup with HyperMinHash sketches.

Every document's set of word shingles is hashed once; each of REGISTERS buckets stores the leading zeros of its smallest
hash and some mantissa bits after them. Buckets that no shingle falls into borrow from others, by a fixed order of their own. Compressed registers
are banded to find candidates. Within a band, the collision-corrected estimate of the Jaccard similarity links sketches; what
these links connect is a block, in which pairs that pass the estimate are compared by their full sets. Pairs that are already connected need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Cache, drop, keyed, release, renamed, sliced, with_ids, written
from sluice.operators.components import components
from sluice.operators.joins import join_back

REGISTERS = 256
BAND = 6
MANTISSA = 10
WORDS = 5
PERCENT = 80
#: The greatest standard deviation of the estimate that was measured at a similarity of 0.8, over set sizes from 5 to 5000
#: (sqrt(0.8 * 0.2 / REGISTERS) = 0.025 where buckets don't borrow). Pairs further below the threshold aren't compared in full.
SPREAD = 0.033
SLACK = 5 * SPREAD
#: Rows of a band that are compared in one task; larger bands are dealt out as pairs of chunks.
BAND_ROWS = 16_384
#: A block whose sets hold more shingles than this is dealt out as pairs of chunks.
BLOCK_SHINGLES = 4_000_000
#: Ids are broadcast, as a filter, up to so many; beyond, a shuffle does the same.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 300_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


class Shingler:
    """Sets of shingles as sorted arrays of distinct 64-bit fingerprints."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.hash = Cache(xxhash.xxh3_64_intdigest, CACHE_WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode().translate(_FOLD).split(b" ") if text else []
        found = [w for w in found if w]
        h = np.fromiter(map(self.hash.__getitem__, found), np.uint64, len(found))
        if not len(h):
            return h
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(len(h), self.words), np.uint64)
        for k in range(min(len(h), self.words)):
            out = _mix(out + h[k : k + n])
        return np.unique(out)


def _orders(registers: int) -> np.ndarray:
    """For each bucket the order in which it asks the others; itself first."""
    rng = np.random.default_rng(256)
    return np.stack([np.concatenate([[i], rng.permutation(np.delete(np.arange(registers), i))]) for i in range(registers)])


_ORDERS = _orders(REGISTERS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty: leading zeros times 2^MANTISSA plus the bits after the leading one."""
    mixed = _mix(shingles ^ _U(0x5851F42D4C957F2D))
    bucket, rest = (mixed & _U(REGISTERS - 1)).astype(np.int64), mixed >> _U(8)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(rest)
    least[bucket[order][::-1]] = rest[order][::-1]  # the last write, the smallest, stays
    filled = least != np.iinfo(np.uint64).max
    if not filled.all():
        empty = np.flatnonzero(~filled)
        least[empty] = least[_ORDERS[empty, filled[_ORDERS[empty]].argmax(axis=1)]]
    bits = np.frexp(least.astype(np.float64))[1]  # exact to the leading bit but for values that round up, alike everywhere
    zeros = np.clip(56 - bits, 0, 62)
    tail = np.where(bits > MANTISSA, least >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64))
    return (zeros.astype(np.uint64) << _U(MANTISSA) | tail & _U((1 << MANTISSA) - 1)).astype(np.uint16)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from numbers of equal registers. Two different minima agree in their leading zeros with
    probability 1/3 and then in all mantissa bits with about 2^-MANTISSA; that share of the unequal is taken off."""
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0, (equal / REGISTERS - chance) / (1 - chance))


def passing(percent: int) -> np.ndarray:
    """For each number of equal registers whether the estimate lets a pair through."""
    return estimate(np.arange(REGISTERS + 1)) >= percent / 100 - SLACK


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    n = REGISTERS // BAND
    cut = registers[:, : n * BAND].reshape(len(registers), n, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), cut.shape[:2])
    for k in range(BAND):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + cut[:, :, k])
    return key


def linked(a: int, b: int, common: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def likely(i: int, label: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int, group: np.ndarray | None, passes: np.ndarray) -> np.ndarray:
    """The later rows of other components (and groups) whose sizes and estimates allow a link with row ``i``."""
    later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
    later = later[linked(sizes[i], sizes[later], np.minimum(sizes[i], sizes[later]), percent)]
    if group is not None:
        later = later[group[later] != group[i]]
    return later[passes[(sketches[later] == sketches[i]).sum(axis=1)]] if len(later) else later


def unite(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Labels are flat: every row carries its component's least index."""
    joined = np.unique(np.append(label[others], label[i]))
    label[np.isin(label, joined)] = joined[0]


def join_sketches(sizes: np.ndarray, sketches: np.ndarray, percent: int, group: np.ndarray | None = None) -> np.ndarray:
    """The local component, as the least index, of each row by estimates alone; a row is held against all later rows that aren't
    connected with it yet. With ``group``, only pairs of different groups are compared."""
    label, passes = np.arange(len(sizes)), passing(percent)
    for i in range(len(sizes) - 1):
        others = likely(i, label, sizes, sketches, percent, group, passes)
        if len(others):
            unite(label, i, others)
    return label


def join_block(sets: list[np.ndarray], sketches: np.ndarray, percent: int, group: np.ndarray | None = None) -> np.ndarray:
    """The local component, as the least index, of each set of a block. With ``group``, only pairs of different
    groups are compared.

    Row by row, estimates against all later rows choose whom to compare; the full sets are compared by marking one set's shingles
    and counting the marks of the others. Only rows of other components are compared, as a link within one changes nothing.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(local) + 1, bool)
    label, passes = np.arange(m), passing(percent)
    for i in range(m - 1):
        later = likely(i, label, sizes, sketches, percent, group, passes)
        if not len(later):
            continue
        mine = local[starts[i] : starts[i + 1]]
        mark[mine] = True
        for lo in range(0, len(later), 4096):
            some = later[lo : lo + 4096]
            n = sizes[some]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - n), n)
            common = np.add.reduceat(mark[local[at]].astype(np.int64), ends - n)
            hit = some[linked(sizes[i], n, common, percent)]
            if len(hit):
                unite(label, i, hit)
        mark[mine] = False
    return label


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(uid, key, n, one, two, sketch): set size, a 128-bit name of the set and its registers; ``docs`` as ``keyed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in sliced(batches):
            n, one, two, registers = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                n.append(len(found))
                name = xxhash.xxh3_128_intdigest(found.tobytes())
                one.append((name >> 64) - (1 << 63))
                two.append((name & (2**64 - 1)) - (1 << 63))
                registers.append(sketch(found).tobytes() if len(found) else None)
            columns = [batch.column("uid"), batch.column("key"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "key", "n", "one", "two", "sketch"])

    return docs.mapInArrow(run, "uid long, key long, n long, one long, two long, sketch binary")


def candidate_blocks(classes: DataFrame, percent: int) -> DataFrame:
    """(uid, block): classes that estimates connect. Classes that share a band come together with their sketches, once
    for all bands that have the same classes; a band of more than BAND_ROWS is dealt out as pairs of chunks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                found = bands(registers)
                uid = np.repeat(batch.column("uid").to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(uid)], names=["band", "uid"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, uid = batch.column("chunks").to_numpy(), batch.column("uid").to_numpy()
            row = np.repeat(np.arange(len(chunks)), chunks)
            own, other = uid[row] % chunks[row], np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            for lo in range(0, len(row), 20_000):
                r, o, p = (c[lo : lo + 20_000] for c in (row, own, other))
                dealt = [batch.column(c).take(pa.array(r)) for c in ("band", "uid", "n", "sketch")]
                yield pa.RecordBatch.from_arrays([*dealt, pa.array(np.minimum(o, p)), pa.array(np.maximum(o, p)), pa.array(o)], names=["band", "uid", "n", "sketch", "x", "y", "chunk"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        uid, chunk, sizes = (group.column(c).to_numpy() for c in ("uid", "chunk", "n"))
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        label = join_sketches(sizes, sketches, percent, chunk if group.column("x")[0].as_py() != group.column("y")[0].as_py() else None)
        other = label != np.arange(len(uid))
        return pa.table({"a": uid[other], "b": uid[label[other]]})

    rows = classes.select("uid", "sketch").mapInArrow(keys, "band long, uid long")
    figures = [F.min("uid").alias("first"), F.max("uid").alias("last"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("uid")).alias("members")]
    shared = rows.groupBy("band").agg(*figures).where("c > 1")
    shared = written(shared.groupBy("first", "last", "c", "members").agg(F.min("band").alias("band")).select("band", "c", F.ceil(F.col("c") / F.lit(BAND_ROWS)).cast("long").alias("chunks")))
    n, total = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if n <= BROADCAST_IDS:  # a row has one key for each band, of which few are shared: the keys stay where they are
        members = written(rows.join(F.broadcast(shared.drop("c")), "band"))
    else:
        members = written(join_back(rows, shared, ["band"], total))
    drop(shared)
    near = F.broadcast(members) if total <= BROADCAST_IDS else members  # so sketches without a shared band aren't shuffled
    dealt = near.join(classes.select("uid", "n", "sketch"), "uid").select("band", "uid", "n", "sketch", "chunks")
    dealt = dealt.mapInArrow(deal, "band long, uid long, n long, sketch binary, x long, y long, chunk long")
    links = written(dealt.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct())
    drop(members)
    return components(links).select(F.col("node").alias("uid"), F.col("component").alias("block"))


def confirmed_links(docs: DataFrame, classes: DataFrame, blocks: DataFrame, words: int, percent: int, block_shingles: int) -> DataFrame:
    """(a, b): links, confirmed on full sets, that connect what is connected. Each member's set is made once more
    from its text and sent to its block; blocks too large for one task are split into chunks, and each pair of chunks is a task."""
    members = blocks.join(classes.select("uid", "n"), "uid")
    large = members.groupBy("block").agg(F.sum("n").alias("total")).where(F.col("total") > block_shingles)
    large = large.select("block", F.ceil(F.lit(2) * F.col("total") / F.lit(block_shingles)).cast("int").alias("chunks"))
    members = written(members.join(large, "block", "left").select("uid", "block", F.coalesce("chunks", F.lit(1)).alias("chunks")))
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            rows = []
            for uid, text, block, chunks in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "block", "chunks")), strict=True):
                found = shingles(text)
                data, registers = found.tobytes(), sketch(found).tobytes()
                own = uid % chunks
                for other in range(chunks):
                    rows.append((block, min(own, other), max(own, other), own, uid, data, registers))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "x", "y", "chunk", "uid", "shingles", "sketch"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        uid, chunk = group.column("uid").to_numpy(), group.column("chunk").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        apart = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        label = join_block(sets, sketches, percent, chunk if apart else None)
        other = label != np.arange(len(uid))
        return pa.table({"a": uid[other], "b": uid[label[other]]})

    dealt = docs.join(members, "uid").select("uid", "text", "block", "chunks").mapInArrow(deal, "block long, x int, y int, chunk int, uid long, shingles binary, sketch binary")
    return dealt.groupBy("block", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row.

    Texts without words (null, empty, blank) have no shingles and link with nothing; shorter texts than a shingle are one
    shingle. Ties need no rule: a component's document is the one with the smallest id. Rows that share an id are told
    apart by their texts, and all of a kept component's rows of that id are kept; rows without an id take part, are kept only
    where no row of their component has an id, and come out with the component's smallest id, null if there is none. Further columns are ignored. No rows give an empty result.
    """
    base = keyed(docs, doc_id, text).select("uid", "key", "text")
    prints, of_class, total = _judged(base, words, percent, block_shingles)
    whole = join_back(prints.where("n > 0").select("one", "two", "uid", "key", "n"), of_class, ["one", "two"], total).select("key", "n", "component_id")
    out = whole.unionByName(prints.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key").eqNullSafe(F.col("component_id")), F.lit(True)).alias("kept"))


def _judged(base: DataFrame, words: int, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame, int]:
    """The fingerprints of ``base``, as ``keyed``, and for each set of shingles (one, two) its component's smallest id and first row,
    (c, component_id, first): its rows, and the uid of a row with that id or, where no row has an id, of any; last, the number of rows with shingles."""
    spark = base.sparkSession
    prints = written(fingerprints(base, words))
    row = F.struct(F.col("key").isNull().alias("nameless"), F.col("uid"))
    classes = prints.where("n > 0").groupBy("one", "two").agg(F.min("uid").alias("uid"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("key").alias("key"), F.min(row).alias("row"), F.count(F.lit(1)).alias("c"))
    classes = written(classes)
    release(spark)
    blocks = written(candidate_blocks(classes, percent))
    release(spark)
    links = written(confirmed_links(base, classes, blocks, words, percent, block_shingles))
    drop(blocks)
    joined = components(links).withColumnRenamed("node", "uid")
    release(spark)
    of_class = written(classes.join(joined, "uid", "left").select("one", "two", "key", "row", "c", F.coalesce("component", "uid").alias("component")))
    drop(classes, links)
    least = of_class.groupBy("component").agg(F.min("key").alias("component_id"), F.min("row").alias("row"), F.sum("c").alias("rows"))
    least = written(least.select("component", "component_id", F.col("row.uid").alias("first"), "rows"))
    total = least.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    of_class = written(join_back(of_class.select("one", "two", "c", "component"), least, ["component"], total, "rows").select("one", "two", "c", "component_id", "first"))
    drop(least)
    return prints, of_class, total


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component: one with its smallest id, of several such that whose text has the smallest
    SHA-256, of rows equal in both the one whose further columns are least. A row without an id stays where no row of its component has one.
    Rows without words are in no component and stay."""
    some, name = renamed(docs)
    rest = [c for n, c in name.items() if n not in ("doc_id", "text")]
    some = some.withColumn("_null", F.col(name["text"]).isNull())
    base = keyed(some, name["doc_id"], name["text"], (*rest, "_null"))
    prints, of_class, total = _judged(base.select("uid", "key", "text"), words, percent, block_shingles)
    prints = prints.where("n > 0").select("one", "two", "uid")
    gone = written(join_back(prints, of_class, ["one", "two"], total).where("uid != first").select("uid").distinct())
    out = with_ids(base, gone, "uid", "left_anti")
    twice = written(prints.groupBy("uid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("uid"))
    if not twice.isEmpty():  # rows of one id and one text share a uid
        copies = with_ids(out, twice, "uid", "left_semi").groupBy("uid").agg(F.min(F.struct(*rest, "_null", "key", "text")).alias("row"))
        out = with_ids(out, twice, "uid", "left_anti").unionByName(copies.select("uid", "row.*"))
    back = {"doc_id": F.col("key").cast(docs.schema["doc_id"].dataType), "text": F.when(~F.col("_null"), F.col("text"))}
    return out.select(*[back.get(n, F.col(c)).alias(n) for n, c in name.items()])


def op6(docs: DataFrame) -> DataFrame:
    """The contract of the query: four-word shingles."""
    return near_duplicates(docs, words=4)


#: Sets of shingles as lists, compared pair by pair where they share a shingle.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
g AS MATERIALIZED (SELECT shingles, min(doc_id) AS doc_id FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0) GROUP BY shingles),
u AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM g),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reached FROM g UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN g ON list_sort(s.shingles) = g.shingles LEFT JOIN c ON g.doc_id = c.node
"""
