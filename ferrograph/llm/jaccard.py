"""Exact Jaccard self-join of documents' word n-gram sets by pivots, Voronoi regions and triangle-inequality windows.

The distance 1 - J is a metric, but unrelated documents are all at distance 1 from each other, and then no pivot tells them
apart: a window around any pivot would hold the whole corpus. So the pivots are documents that others share something with.
All grams have one order, that of their hashes, and the elements of a set are its pairs of neighbours in that order: common grams
mostly have rare neighbours, so that unlike documents share few elements. If x and y have o grams in common, they have at least
3 o - |x| - |y| - 1 elements in common, so at least s = (2 t - 1) |x| - 1 of the larger one's, x. Elements are ordered from rare to
common (by counts of both grams over the whole corpus in 2**``RANK_BITS`` cells, ties by hash), and by the prefix principle two
similar sets have about k elements of the larger one in common already among the first |x| - 1 - s + k of each. (Small sets use
their grams alone as elements, sets just above the small ones use both kinds.) The documents with an element in common make a bucket.
In the end every element is shared with some document by chance, but few with the same one; so buckets of up to ``FEW_DOCS``
documents count how many elements each pair of them has in common, c, and the one of the pair with the smaller key is its pivot. In
larger buckets, s_x of which hold x, all documents meet by the one with the smallest key. A pair with c + s_x < k isn't similar, x
being the larger one. It is in a region if c is a third of k at least; if not, it has more than k - k / 3 elements in common in large
buckets. So a document with no more of these needs none of their pivots; of those of the others, the ones go by which it meets
others in no more than (k - k / 3) / 2 elements in all, as then every similar pair still has a pivot
in common. The documents of a pivot are its region. Documents that can't be similar to any other of their region, by
counts of their grams in a few cells, leave it before whole sets are sent. A region over ``MAX_REGION`` documents is divided by
pivots of its own: each document goes to the Voronoi cell of its nearest pivot, and to the cell of each pivot p with d(x, p)
<= d(x, nearest) + 2 r, for r = 1 - t, so that both documents of a pair are in some cell together; a region that its pivots
can't divide is compared in blocks. Executors divide regions further in the same way, until documents are compared one with
another, where |d(x, p) - d(y, p)| <= r doesn't rule them out. A pair that is in several regions counts in the first.
Nothing is approximate or capped, and there is one plan at every size.

Documents with equal sets count as one until the end, and elements are sent once from each task for equal sets.

Defined cases: a text with fewer than n words has its words together as its only gram; a null text or one without words has no
gram and is similar to none. Rows with a null id are left out of pairs and groups. Rows with the same id are one document, which
is in no pair with itself, and whose texts are in one class. Very long texts are taken whole. Ties don't arise: all pairs count.
Each pair comes once, the smaller id first, and has the largest of its rows' similarities. An empty table has no pair and no
group. Columns besides the id and the text may have any names; they pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ferrograph.llm import grams
from ferrograph.llm.frames import Sieve, free, staged, without

N = 2
#: In the given tables similarities of unlike texts end below it, and those of near copies begin above (see the README).
THRESHOLD = 0.6
MAX_REGION = 8000
RANK_BITS = 18
#: Elements that two similar sets must have in common, beyond one, as a share of a set's grams, from a threshold on. What unlike sets share by chance has to stay below.
MARGINS = ((0.7, 0.05), (0.0, 0.1))
#: Up to so many documents with an element in common are paired. More make more rows of copies, fewer more candidates of large tables by chance (see the README).
FEW_DOCS = 8
#: Elements to a bucket, and elements that a task holds before it sends them.
BUCKET = 3_000_000
HELD = 4_000_000
PIVOTS = 12
LEAF = 48
#: From this threshold on, signatures of few cells tell unlike sets apart.
FEW_CELLS = 0.7
#: Elements are 48 bits of a hash, and documents 40 bits of their keys, until whole keys are joined: what is equal by chance only makes candidates.
ELEMENT_BITS = 48
SHORT_BITS = 40


class Sets:
    """The sorted grams of each document of a chunk: those of document d are flat[ptr[d]:ptr[d + 1]], keys[d] is a hash of them all, 0 where there is none."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int = N):
        h, doc = grams.words(data, off)
        g, at = grams.word_grams(h, doc, n)
        docs = np.arange(len(off) - 1)
        w_lo, w_hi = np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")
        few = np.flatnonzero((w_hi > w_lo) & (w_hi - w_lo < n))
        if len(few):
            whole = [np.bitwise_xor.reduce(h[w_lo[d] : w_hi[d]] * np.arange(3, 3 + 2 * (w_hi[d] - w_lo[d]), 2, dtype=np.uint64)) for d in few.tolist()]
            g, at = np.concatenate([g, grams.mix(np.array(whole, np.uint64))]), np.concatenate([at, few])
            order = np.argsort(at, kind="stable")
            g, at = g[order], at[order]
        g = g.copy()
        edge = np.searchsorted(at, np.arange(len(docs) + 1))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g[lo:hi].sort()
        once = np.append(True, (g[1:] != g[:-1]) | (at[1:] != at[:-1]))[: len(g)]
        self.flat, at = g[once], at[once]
        self.ptr = np.searchsorted(at, np.arange(len(docs) + 1))
        self.size = np.diff(self.ptr)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams.mix(self.flat ^ np.uint64(0xABCDEF)), dtype=np.uint64)])
        key = grams.mix(grams.mix(sums[self.ptr[1:]] - sums[self.ptr[:-1]] + self.size.astype(np.uint64))) | np.uint64(1)
        self.keys = np.where(self.size > 0, key, np.uint64(0)).astype(np.int64)

    def __getitem__(self, d: int) -> np.ndarray:
        return self.flat[self.ptr[d] : self.ptr[d + 1]]

    def new(self, seen: set[int]) -> list[int]:
        """The documents with grams whose set isn't among those seen; these are added."""
        out = []
        for d, key in enumerate(self.keys.tolist()):
            if key and key not in seen:
                seen.add(key)
                out.append(d)
        return out


def gram_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> Iterator[np.ndarray]:
    own = Sets(data, off, n)
    return (own[d] for d in range(len(own.size)))


def signature(own: np.ndarray, t: float) -> bytes:
    """How many grams fall into each of n / 8 to n / 4 cells (n / 2.8 to n / 1.4 at thresholds where those would tell too little), in half a byte each if all fit."""
    m = 1 << max(5, int(np.log2(len(own) / (4 if t >= FEW_CELLS else 1.4))))
    n = np.bincount((own >> np.uint64(65 - m.bit_length())).astype(np.int64), minlength=m)
    if n.max() < 16:
        return b"h" + (n[::2] << 4 | n[1::2]).astype(np.uint8).tobytes()
    return b"w" + np.minimum(n, 2**31 - 1).astype("<i4").tobytes()


def cell_counts(raw: bytes) -> np.ndarray:
    if raw[:1] == b"w":
        return np.frombuffer(raw, "<i4", offset=1)
    half = np.frombuffer(raw, np.uint8, offset=1)
    return np.stack([half >> 4, half & 15], 1).reshape(-1).astype(np.int32)


def census(docs: DataFrame, n: int, t: float) -> DataFrame:
    """Of each document with grams (id, key, short, size), with cells for one at least of each key; and rows with a block and its counts of all grams by cell."""
    schema = T.StructType([docs.schema["id"], *(T.StructField(*f) for f in (("key", T.LongType()), ("short", T.LongType()), ("size", T.LongType()), ("cells", T.BinaryType()), ("block", T.IntegerType()), ("counts", T.BinaryType())))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << RANK_BITS, np.int64), set()
        for batch in batches:
            for lo, hi, data, off in grams.chunks(batch.column("text")):
                own = Sets(data, off, n)
                total += np.bincount((own.flat >> np.uint64(64 - RANK_BITS)).astype(np.int64), minlength=len(total))
                cells: list[bytes | None] = [None] * (hi - lo)
                for d in own.new(seen):
                    cells[d] = signature(own[d], t)
                columns = [batch.column("id").slice(lo, hi - lo), pa.array(own.keys), pa.array(shorts(own.keys)), pa.array(own.size), pa.array(cells, pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow).filter(pa.array(own.keys != 0))
        if total.any():
            blocks = total.reshape(-1, 4096)
            columns = [*(pa.nulls(len(blocks), f.type) for f in list(arrow)[:5]), pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def shorts(keys: np.ndarray) -> np.ndarray:
    """The upper bits of keys."""
    return (keys.astype(np.uint64) >> np.uint64(64 - SHORT_BITS)).astype(np.int64)


def ranks(counts: DataFrame) -> np.ndarray:
    """How common the grams of each cell are, on a scale of logarithms; 512 KB. counts: (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(raw, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(1 << RANK_BITS, np.int64)
    for r in counts.repartition("block").mapInArrow(run, "block int, counts binary").collect():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(np.round(1000 * np.log2(1 + out)), 65535).astype(np.uint64)


def small(t: float) -> int:
    """Sets of so many grams at most use these alone as elements."""
    return int(np.ceil(3 / (2 * t - 1))) if t > 0.51 else 1 << 60


def needed(size: np.ndarray, t: float) -> np.ndarray:
    """How many elements a set of that size has in common with a similar one of its size or more."""
    margin = next(m for least, m in MARGINS if t >= least)
    most = np.ceil((2 * t - 1) * size - 1 - 1e-9)
    return np.maximum(1, np.where(size <= small(t) / t, 1, np.minimum(1 + np.floor(margin * size), most))).astype(np.int64)


def elements(own: Sets, docs: np.ndarray, rank: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the prefixes of some documents, and the document of each."""
    size = own.size[docs]
    doc = np.repeat(docs, size)
    begin = np.cumsum(size) - size
    place = np.arange(len(doc)) - np.repeat(begin, size)
    g = own.flat[np.repeat(own.ptr[docs], size) + place]
    how = rank[g >> np.uint64(64 - RANK_BITS)]
    k = needed(size, t)
    alone = np.where(size <= small(t) / t, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1, 0)
    pairs = np.where(size > small(t), np.minimum(size - 1, size - 1 - np.ceil((2 * t - 1) * size - 1 - 1e-9).astype(np.int64) + k), 0)
    few = np.flatnonzero(np.repeat(alone > 0, size))
    c = how[few] << np.uint64(48) | grams.mix(g[few]) >> np.uint64(16)
    c = c[np.lexsort((c, np.repeat(np.arange(len(docs)), size)[few]))]
    one, two = place[few] < np.repeat(alone, size)[few], place < np.repeat(pairs, size)
    e = np.full(len(g), np.iinfo(np.uint64).max)
    inner = np.flatnonzero(place < np.repeat(size - 1, size))
    e[inner] = how[inner] + how[inner + 1] << np.uint64(47) | grams.mix(g[inner] * np.uint64(grams.BASE) + g[inner + 1]) >> np.uint64(17)
    for lo, hi in zip(begin[pairs > 0].tolist(), (begin + size)[pairs > 0].tolist(), strict=True):
        e[lo:hi].sort()
    return np.concatenate([grams.mix(c[one] ^ np.uint64(0x51A7)), grams.mix(e[two])]), np.concatenate([doc[few][one], doc[two]])


def packed(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Numbers as planes of their lower bytes, compressed. columns: unsigned numbers, and how many bytes of each to keep."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T) for c, width in columns]
    raw = np.concatenate(planes).tobytes()
    return len(columns[0][0]).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(raw: bytes, widths: list[int]) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], n * sum(widths), codec="zstd", asbytes=True), np.uint8).reshape(sum(widths), n)
    out, at = [], 0
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = planes[at : at + width].T
        out.append(full.view("<u8").reshape(-1))
        at += width
    return out


def sent(bucket: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data), for numbers in order of their buckets."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(edge[1:], len(bucket))
    for k in range(0, len(edge), 256):
        data = [packed([(c[a:b], w) for c, w in columns]) for a, b in zip(edge[k : k + 256].tolist(), ends[k : k + 256].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[k : k + 256]].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def bucket_of(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of equal width of numbers of so many bits."""
    return (x >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)


def by_bucket(rows: DataFrame, buckets: int, widths: list[int], done: Callable, schema: str) -> DataFrame:
    """The batches that ``done`` makes of all numbers of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(raw)
        for bucket in sorted(held):
            parts = [unpacked(raw, widths) for raw in held.pop(bucket)]
            yield from done(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)


WIDTHS = [6, 5, 1]
EDGE_WIDTHS = [5, 5, 3, 1, 1]


def bucket_rows(docs: DataFrame, rank: np.ndarray, buckets: int, n: int, t: float) -> DataFrame:
    """(bucket, data): elements with the short keys and sizes of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e, key, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(e)
            e = e[order] >> np.uint64(64 - ELEMENT_BITS)
            yield from sent(bucket_of(e, ELEMENT_BITS, buckets), list(zip([e, key[order], size[order]], WIDTHS, strict=True)))

        count = 0
        for batch in batches:
            for _, _, data, off in grams.chunks(batch.column("text")):
                own = Sets(data, off, n)
                docs_here = np.array(own.new(seen), np.int64)
                if not len(docs_here):
                    continue
                e, doc = elements(own, docs_here, rank, t)
                held.append((e, shorts(own.keys).astype(np.uint64)[doc], scaled(own.size)[doc]))
                count += len(e)
                if count >= HELD:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, data binary")


def scaled(size: np.ndarray) -> np.ndarray:
    """Sizes in a byte, rounded down."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(1, size)) + 1e-9)).astype(np.uint64)


def least_needed(size: np.ndarray, t: float) -> np.ndarray:
    """How many elements a set of a scaled size meets any similar one in, at least."""
    return met(np.floor(2.0 ** (size.astype(float) / 8) + 1e-6).astype(np.int64), t)


def met(size: np.ndarray, t: float) -> np.ndarray:
    """How many elements a set of that size or more has in common with any similar one.

    Sets lose s - k of the elements that they share, s by the larger one; as s - k grows with the size but for one by rounding, k of the
    larger set less one are left. Partners that may be small use other elements: k of the smallest one counts for these.
    """
    least = np.ceil(t * size - 1e-6).astype(np.int64)
    return np.maximum(needed(least, t), np.where(least > small(t) / t, needed(size, t) - 1, 1))


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal rows, and the run of each row."""
    first = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))[: len(columns[0])]
    return np.flatnonzero(first), np.cumsum(first) - 1


def summed(key: np.ndarray, other: np.ndarray, times: np.ndarray, size: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """Equal rows (key, other, pair) once, with the sum of their times and their smallest size."""
    order = np.lexsort((pair, other, key))
    key, other, times, size, pair = (x[order] for x in (key, other, times, size, pair))
    begin, _ = runs(key, other, pair)
    return [key[begin], other[begin], np.add.reduceat(times, begin), np.minimum.reduceat(size, begin), pair[begin]]


def star_rows(rows: DataFrame, buckets: int, t: float) -> DataFrame:
    """(bucket, data): documents, others, in how many elements they meet, sizes of the documents, and whether a row is of a pair.

    The other one of a pair is of the same size or smaller; that of other rows is the pivot of a bucket of many. A bucket is cut where
    the next size is too large for a similar set.
    """
    far = int(np.floor(8 * np.log2(1 / t) + 1e-9)) + 1

    def stars(e: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(e)
        e = e[order]
        same = e[1:] == e[:-1]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        e, key, size = e[some], key[order[some]], size[order[some]].astype(np.int64)
        order = np.lexsort((key, size, e))
        e, key, size = e[order], key[order], size[order]
        once, _ = runs(e, size, key)
        e, key, size = e[once], key[once], size[once]
        if not len(key):
            return
        cut = np.append(True, (e[1:] != e[:-1]) | (size[1:] - size[:-1] > far))
        begin, of = np.flatnonzero(cut), np.cumsum(cut) - 1
        count = np.diff(np.append(begin, len(e)))[of]
        many, few = count > FEW_DOCS, (count > 1) & (count <= FEW_DOCS)
        held = [summed(key[many], np.minimum.reduceat(key, begin)[of][many], np.ones(int(many.sum()), np.int64), size[many], np.zeros(int(many.sum()), np.int64))]
        for lag in range(1, FEW_DOCS):
            x = np.flatnonzero(few[lag:] & (of[lag:] == of[:-lag])) + lag
            x = x[size[x] - size[x - lag] <= far]
            held.append(summed(key[x], key[x - lag], np.ones(len(x), np.int64), size[x], np.ones(len(x), np.int64)))
            if sum(len(part[0]) for part in held) >= HELD // 4 or lag == FEW_DOCS - 1:
                found, other, times, z, pair = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held.clear()
                if len(found):
                    yield from sent(bucket_of(found, SHORT_BITS, max(1, buckets // 4)), list(zip([found, other, times, z, pair], EDGE_WIDTHS, strict=True)))

    return by_bucket(rows, buckets, WIDTHS, stars, "bucket int, data binary")


def regions(rows: DataFrame, buckets: int, t: float) -> DataFrame:
    """(region, short): the pivots that each document needs to meet every similar one. A row may come more than once."""

    def chosen(key: np.ndarray, other: np.ndarray, times: np.ndarray, size: np.ndarray, pair: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, other, times, size, pair = summed(key, other, times.astype(np.int64), size, pair)
        begin, of = runs(key)
        k = least_needed(np.minimum.reduceat(size, begin), t)
        third = -(-k // 3)
        among_many = np.add.reduceat(np.where(pair == 0, times, 0), begin)
        near = np.flatnonzero((pair > 0) & (times >= third[of]) & (times + among_many[of] >= k[of]))
        star = np.flatnonzero((pair == 0) & (among_many > k - third)[of])
        star = star[np.lexsort((times[star], of[star]))]
        upto = np.cumsum(times[star]) - (np.cumsum(among_many * (among_many > k - third)) - among_many)[of[star]]
        star = star[upto > ((k - third) // 2)[of[star]]]
        pivot = np.minimum(key[near], other[near])
        region, short = np.concatenate([other[star], pivot, pivot]), np.concatenate([key[star], key[near], other[near]])
        if len(region):
            yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int64)), pa.array(short.astype(np.int64))], names=["region", "short"])

    return by_bucket(rows, max(1, buckets // 4), EDGE_WIDTHS, chosen, "region long, short long")


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows, from batches that are sorted by a number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(by)[-1].as_py() != int(key[0]):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def whole_sets(docs: DataFrame, wanted: Sieve, n: int) -> DataFrame:
    """(key, grams) of the documents whose short key may be wanted, once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, off in grams.chunks(batch.column("text")):
                own = Sets(data, off, n)
                own.keys[~wanted.has(own.keys)] = 0
                some = own.new(seen)
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(own.keys[some]), pa.array([own[d].tobytes() for d in some], pa.binary())], names=["key", "grams"])

    return docs.select("text").mapInArrow(run, "key long, grams binary")


def plausible(rows: DataFrame, t: float) -> DataFrame:
    """(region, key) of those that may be similar to another of their region that is in no region before with them: |x & y| is at most the sum over cells of the smaller count.

    rows: (region, all, key, size, cells); all has all regions of the key, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "region"):
            region, key, size = (table[c].to_numpy() for c in ("region", "key", "size"))
            counts, lists = table["cells"].combine_chunks(), table["all"].combine_chunks()
            first = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
            good = np.zeros(len(region), bool)
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if hi - lo > 1:
                    bits = before(int(region[lo]), [lists[j].values.to_numpy() for j in range(lo, hi)])
                    good[lo:hi] = some_near([counts[j].as_buffer().to_pybytes() for j in range(lo, hi)], size[lo:hi], bits, t)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(region[good]), pa.array(key[good])], names=["region", "key"])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, key long")


def some_near(cells: list[bytes], size: np.ndarray, bits: np.ndarray, t: float) -> np.ndarray:
    """Which sets may be similar to another one of these with which they have no bit in common, by their counts in cells."""
    order = np.argsort(size, kind="stable")
    n, bits = size[order], bits[order]
    good = np.zeros(len(n), bool)
    limit = (1 - t) / (1 + t)
    at = 0
    while at < len(n):  # rows whose partners have the same number of cells or more
        first = cell_counts(cells[order[at]])
        m, counts, same = len(first), [first], at + 1
        while at + len(counts) < len(n) and n[at + len(counts)] <= n[same - 1] / t + 1e-9:
            own = cell_counts(cells[order[at + len(counts)]])
            if len(own) == m and same == at + len(counts):
                same += 1
            counts.append(own.reshape(m, -1).sum(1, dtype=np.int32))
        rows = np.array(counts)
        for i in range(same - at):
            far = int(np.searchsorted(n, n[at + i] / t + 1e-9, side="right")) - at
            if good[at + i] and good[at + i + 1 : at + far].all():
                continue
            apart = np.abs(rows[i + 1 : far] - rows[i]).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart <= (n[at + i + 1 : at + far] + n[at + i]) * limit + 1e-6)
            if len(near):
                near = near[~(bits[at + i + 1 + near] & bits[at + i]).any(1)]
            if len(near):
                good[at + i] = True
                good[at + i + 1 + near] = True
        at = same
    out = np.zeros(len(n), bool)
    out[order] = good
    return out


class Region:
    """Some sets, with their grams numbered."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray]):
        self.keys, self.size = keys, np.array([len(x) for x in sets])
        self.ptr = np.concatenate([[0], np.cumsum(self.size)])
        grams_here, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(grams_here), bool)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """|x & y| for each y of others."""
        own = self.flat[self.ptr[x] : self.ptr[x + 1]]
        self.mark[own] = True
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ptr[others] - (ends - sizes), sizes) + np.arange(ends[-1]) if len(others) else np.zeros(0, np.int64)
        hit = np.add.reduceat(self.mark[self.flat[at]], ends - sizes, dtype=np.int64) if len(others) else np.zeros(0, np.int64)
        self.mark[own] = False
        return hit

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(x, others)
        return 1 - both / (self.size[x] + self.size[others] - both)

    def pivots(self, among: np.ndarray, count: int) -> tuple[list[int], np.ndarray]:
        """Pivots, each as far as can be from those before, and all distances from them."""
        chosen, rows = [int(among[0])], [self.distance(int(among[0]), among)]
        while len(chosen) < count:
            nearest = np.min(rows, axis=0)
            k = int(nearest.argmax())
            if nearest[k] <= 0:
                break
            chosen.append(int(among[k]))
            rows.append(self.distance(int(among[k]), among))
        return chosen, np.array(rows)

    def join(self, among: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, |x & y|) of all pairs with J >= t; a pair may come more than once."""
        if len(among) < 2:
            return
        r = 1 - t + 1e-9
        if len(among) > LEAF:
            _, d = self.pivots(among, PIVOTS)
            nearest = d.min(0)
            home = d.argmin(0)
            cells = [np.flatnonzero(row <= nearest + 2 * r) for row in d]
            cells = [c for k, c in enumerate(cells) if (home == k).any()]
            if sum(len(c) ** 2 for c in cells) < 0.6 * len(among) ** 2 and max(map(len, cells)) < len(among):
                for c in cells:
                    yield from self.join(among[c], t)
                return
        else:
            d = self.distance(int(among[0]), among)[None]
        order = np.argsort(self.size[among], kind="stable")
        among, d = among[order], d[:, order]
        size = self.size[among]
        for i in range(len(among) - 1):
            end = int(np.searchsorted(size, size[i] / t + 1e-9, side="right"))
            near = np.arange(i + 1, end)
            for row in d:
                near = near[np.abs(row[near] - row[i]) <= r]
            if len(near):
                both = self.shared(int(among[i]), among[near])
                ok = both >= t * (size[i] + size[near] - both) - 1e-9
                if ok.any():
                    yield np.full(int(ok.sum()), among[i]), among[near[ok]], both[ok]

    def pairs(self, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair with J >= t once."""
        found = list(self.join(np.arange(len(self.keys)), t))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        x, y, both = (np.concatenate(c) for c in zip(*found, strict=True))
        x, y = np.minimum(x, y), np.maximum(x, y)
        _, once = np.unique(x * len(self.keys) + y, return_index=True)
        return x[once], y[once], both[once]


def before(region: int, lists: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each document: in which of the regions before this one it is."""
    earlier = [x[x < region] for x in lists]
    names = np.unique(np.concatenate(earlier))
    bits = np.zeros((len(lists), len(names) // 64 + 1), np.uint64)
    for row, own in zip(bits, earlier, strict=True):
        at = np.searchsorted(names, own)
        np.bitwise_or.at(row, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n can reach by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def region_rows(members: DataFrame, sets: DataFrame, t: float, kernel: Callable, schema: str) -> DataFrame:
    """What the kernel makes of (keys, sizes, x, y, shared, root) of each region; pairs x, y are in no region before. members: (region, key)."""
    lists = members.groupBy("key").agg(F.sort_array(F.collect_set("region")).alias("all"))
    rows = sets.join(lists, "key").select(F.explode("all").alias("region"), "key", "all", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "region"):
            region, keys = table["region"].to_numpy(), table["key"].to_numpy()
            sets, lists = table["grams"].combine_chunks(), table["all"].combine_chunks()
            first = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                order = lo + np.argsort(keys[lo:hi], kind="stable")
                own = Region(keys[order], [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in order.tolist()])
                x, y, both = own.pairs(t)
                if len(x):
                    bits = before(int(region[lo]), [lists[k].values.to_numpy() for k in order.tolist()])
                    once = ~(bits[x] & bits[y]).any(1)
                    out = kernel(own.keys, own.size, x[once], y[once], both[once], roots(x, y, hi - lo))
                    if out.num_rows:
                        yield out

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, schema)


def listed_pairs(keys: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, both: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys[x]), pa.array(keys[y]), pa.array(both / (size[x] + size[y] - both))], names=["key_a", "key_b", "jaccard"])


def counted_links(keys: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, both: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    links = np.bincount(x, minlength=len(keys)) + np.bincount(y, minlength=len(keys))
    some = np.flatnonzero((links > 0) | (root != np.arange(len(keys))))
    return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(keys[root[some]]), pa.array(links[some].astype(np.int64))], names=["key", "root", "links"])


def divide(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], t: float, most: int) -> DataFrame:
    """(region, key), with regions over ``most`` documents divided by pivots of their own, as long as that helps, and into pairs of blocks then. sets_of: (key, grams) of some keys at least."""
    done = None
    for level in range(12):
        size = members.groupBy("region").agg(F.count("*").alias("n"))
        large = staged(size.filter(F.col("n") > most), "large")
        if large.isEmpty():
            return members if done is None else done.unionByName(members)
        by = Window.partitionBy("region").orderBy(F.xxhash64("key", F.lit(level)), "key")
        inside = staged(members.join(large, "region"), "inside")
        sets = staged(sets_of(inside.select("key")), "sets")
        chosen = inside.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= PIVOTS)
        pivots = chosen.join(sets, "key").groupBy("region").agg(F.collect_list(F.struct(F.col("key").alias("pivot"), "grams")).alias("pivots"))
        rows = inside.join(pivots, "region").join(sets.withColumnRenamed("grams", "own"), "key").select("region", "key", "own", "pivots")

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for region, key, own, near in zip(*(batch.column(n).to_pylist() for n in ("region", "key", "own", "pivots")), strict=True):
                    x = np.frombuffer(own, np.uint64)
                    d = []
                    for p in near:
                        y = np.frombuffer(p["grams"], np.uint64)
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        d.append(1 - both / (len(x) + len(y) - both))
                    out += [(region, p["pivot"], key) for p, dist in zip(near, d, strict=True) if dist <= min(d) + 2 * (1 - t) + 1e-9]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["was", "pivot", "key"])

        split = rows.mapInArrow(cells, "was long, pivot long, key long").withColumn("region", F.xxhash64("was", "pivot", F.lit(level)))
        split = staged(split, "cells")
        before = large.select(F.col("region").alias("was"), F.col("n").alias("n_was"))
        worse = split.groupBy("was", "region").agg(F.count("*").alias("n")).join(before, "was")
        worse = worse.groupBy("was").agg(F.max("n").alias("top"), F.sum(F.col("n").cast("double") * F.col("n")).alias("work"), F.first("n_was").alias("n_was"))
        stuck = worse.filter((F.col("top") >= 0.95 * F.col("n_was")) | (F.col("work") >= 0.8 * F.col("n_was") * F.col("n_was")))
        stuck = staged(stuck.select(F.col("was").alias("region"), "n_was"), "stuck")
        final = members.join(large, "region", "left_anti").unionByName(blocks(members.join(stuck, "region"), most))
        done = final if done is None else done.unionByName(final)
        members = split.join(stuck.select(F.col("region").alias("was")), "was", "left_anti").select("region", "key")
    rest = members.join(members.groupBy("region").agg(F.count("*").alias("n_was")), "region")
    return done.unionByName(blocks(rest, most))


def blocks(members: DataFrame, most: int) -> DataFrame:
    """(region, key): each pair of blocks of a region is a region of its own. members: (region, key, n_was)."""
    count = F.ceil(F.col("n_was") * 2 / most).cast("long")
    own = members.withColumn("b", F.pmod(F.xxhash64("key", F.lit("block")), count)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    own = own.filter((F.col("b") != F.col("other")) | (count == 1))  # the pairs within a block are in all its regions
    return own.select(F.xxhash64("region", F.least("b", "other"), F.greatest("b", "other"), F.lit("block")).alias("region"), "key")


def joined(docs: DataFrame, n: int, t: float, max_region: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, key) of the documents with grams, (region, key), and (key, grams) of all keys in regions. docs: (id, text)."""
    texts = docs.filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    counted = staged(census(texts, n, t), "census")
    ids = counted.filter(F.col("block").isNull())
    rank = ranks(counted.filter(F.col("block").isNotNull()).select("block", "counts"))
    total = ids.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    members = staged(regions(star_rows(bucket_rows(texts, rank, buckets, n, t), buckets, t), buckets, t), "regions")
    coarse = ids.filter(F.col("cells").isNotNull()).select("short", "key", "size", "cells").dropDuplicates(["key"])
    several = members.groupBy("region").count().filter("count > 1").select("region")
    lists = members.join(several, "region").groupBy("short").agg(F.sort_array(F.collect_set("region")).alias("all"))
    rows = coarse.join(lists, "short").select(F.explode("all").alias("region"), "all", "key", "size", "cells")
    members = staged(plausible(rows, t), "members")
    sets = whole_sets(texts, Sieve.of(members.select("key"), "key"), n).dropDuplicates(["key"])
    return ids.select("id", "key"), divide(members, lambda keys: whole_sets(texts, Sieve.of(keys, "key"), n).dropDuplicates(["key"]), t, max_region), sets


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD, max_region: int = MAX_REGION) -> DataFrame:
    """All pairs ``doc_a < doc_b`` with ``jaccard`` >= t; as many as there are, also among copies."""
    ids, members, sets = joined(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), n, t, max_region)
    pairs = staged(region_rows(members, sets, t, listed_pairs, "key_a long, key_b long, jaccard double"), "pairs")
    lists = ids.groupBy("key").agg(F.collect_set("id").alias("ids"))
    a, b = lists.select(F.col("key").alias("key_a"), F.col("ids").alias("a")), lists.select(F.col("key").alias("key_b"), F.col("ids").alias("b"))
    crossed = pairs.join(a, "key_a").join(b, "key_b").select("a", "b", "jaccard")
    same = lists.filter(F.size("ids") > 1).select(F.col("ids").alias("a"), F.col("ids").alias("b"), F.lit(1.0).alias("jaccard"))
    found = crossed.unionByName(same).select(F.explode("a").alias("a"), "b", "jaccard").select("a", F.explode("b").alias("b"), "jaccard")
    same_rows = found.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return same_rows.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """``(key, group)`` of all keys in edges (key_a, key_b); the group is the smallest key that can be reached."""
    edges = staged(edges.select(F.col("key_a").alias("x"), F.col("key_b").alias("y")).union(edges.select("key_b", "key_a")).distinct(), "links")
    label = staged(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("key"), F.least("x", "y").alias("group")), "label")
    while True:
        heard = edges.join(label, edges["y"] == label["key"]).select(F.col("x").alias("key"), "group")
        jumped = label.select(F.col("key"), F.col("group").alias("via")).join(label.select(F.col("key").alias("via"), F.col("group").alias("to")), "via").select("key", F.col("to").alias("group"))
        new = staged(heard.unionByName(jumped).unionByName(label).groupBy("key").agg(F.min("group").alias("group")), "label")
        if new.join(label.withColumnRenamed("group", "was"), "key").filter(F.col("group") != F.col("was")).isEmpty():
            return new
        label = new


def key_groups(docs: DataFrame, n: int, t: float, max_region: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, key); (key, links), how many other sets are similar; (key, group). docs: (id, text)."""
    ids, members, sets = joined(docs, n, t, max_region)
    found = staged(region_rows(members, sets, t, counted_links, "key long, root long, links long"), "found")
    several = ids.groupBy("id").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") > 1)  # texts of one id hang together
    own = several.select(F.array_min("keys").alias("key_a"), F.explode("keys").alias("key_b"))
    edges = found.select(F.col("key").alias("key_a"), F.col("root").alias("key_b")).unionByName(own)
    return ids, found.groupBy("key").agg(F.sum("links").alias("links")), components(edges.filter("key_a != key_b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD, max_region: int = MAX_REGION) -> DataFrame:
    """One row for each id: its ``class_id``, the smallest id that it is linked with through similar texts; ``copies``, how many other ids have an equal set of grams; ``links``, how many other sets are similar to its own."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    ids, links, groups_of = key_groups(rows, n, t, max_region)
    own = ids.distinct()
    sized = own.groupBy("key").agg((F.count("*") - 1).alias("copies"), F.min("id").alias("first"))
    keys = sized.join(links, "key", "left").join(groups_of, "key", "left").select("key", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "key").alias("group"))
    keys = staged(keys, "keys")
    least = keys.groupBy("group").agg(F.min("first").alias("class_id"))
    found = own.join(keys, "key").join(least, "group").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"))
    every = rows.select("id").filter(F.col("id").isNotNull()).distinct().join(found, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), zero("copies"), zero("links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD, max_region: int = MAX_REGION) -> DataFrame:
    """``docs`` without those that are linked by similar pairs to a document with a smaller id. Rows without grams or id stay, and rows of one id stay or go together."""
    ids, _, groups_of = key_groups(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), n, t, max_region)
    grouped = ids.join(groups_of, "key", "left").select("id", F.coalesce("group", "key").alias("group"))
    best = grouped.groupBy("group").agg(F.min("id").alias("best"), F.max("id").alias("last")).filter(F.col("best") != F.col("last")).select("group", "best")
    name = free(docs.columns, "gone")
    lost = grouped.join(best, "group").filter(F.col("id") != F.col("best")).select(F.col("id").alias(name)).distinct()
    return without(docs, lost, id_col, name)
