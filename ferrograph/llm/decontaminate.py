"""Benchmark decontamination: q-gram lemma filtering over overlapping diagonal bands, then banded alignment.

Documents and benchmark items are compared in lower case with every run of other signs as one space. An item of m bytes may
differ from a place in a document by k = floor(EDIT_RATE * m) edits (none below ``EDIT_FROM`` bytes). By the q-gram lemma such
a place shares at least m - q + 1 - k * q q-grams with the item, all within k + 1 neighbouring diagonals. Shared q-grams are
counted in bands of 2 (k + 1) diagonals, each k + 1 further on, so that some band holds them all; bands that reach the count
are verified by a semi-global alignment within the band. Nothing is approximate.

The index of the items is sent to the executors; it holds at most ``MAX_INDEX_BYTES`` of items at a time, and further items
are searched for by further passes over the documents. Documents aren't shuffled.

Defined cases: a null or empty text holds no item. Null items, and those under ``MIN_ITEM`` bytes in this form, which mark
nothing, are never found. Equal items and rows with the same id are each reported. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm import grams
from ferrograph.llm.frames import free, text_columns

Q = 12
EDIT_RATE = 0.05
EDIT_FROM = 24
MIN_ITEM = 16
MAX_INDEX_BYTES = 16 << 20
FILTER_BITS = 22


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text in the compared form, its offsets, and where each of its bytes stood."""
    out = np.where(grams.WORD[data], grams.lower(data), np.uint8(32))
    keep = out != 32
    keep[1:] |= keep[:-1].copy() if len(keep) else False
    starts = off[:-1][off[:-1] < off[1:]]
    keep[starts] = out[starts] != 32
    at = np.flatnonzero(keep)
    out, new = out[at], np.searchsorted(at, off)
    if len(out):  # no space at the end of a document
        last = new[1:][new[1:] > new[:-1]] - 1
        trim = last[out[last] == 32]
        if len(trim):
            keep = np.ones(len(out), bool)
            keep[trim] = False
            out, at, new = out[keep], at[keep], new - np.searchsorted(trim, new)
    return out, new, at


@dataclass
class Index:
    """q-grams of some items, sorted, with all places of each."""

    items: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    gram: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray


def index(texts: list[str]) -> Index:
    data, off = grams.text_bytes(pa.array(texts, pa.large_string()))
    out, new, _ = plain(data, off)
    items = [out[a:b].tobytes() for a, b in zip(new[:-1], new[1:], strict=True)]
    m = np.diff(new)
    edits = np.where(m >= EDIT_FROM, np.floor(EDIT_RATE * m + 1e-9), 0).astype(np.int64)
    least = np.maximum(1, m - Q + 1 - edits * Q)
    g, at = all_grams(out)
    own = np.searchsorted(new, at, side="right") - 1
    fit = (at + Q <= new[own + 1]) & (m[own] >= MIN_ITEM)
    g, at, own = g[fit], at[fit], own[fit]
    order = np.argsort(g, kind="stable")
    g, at, own = g[order], at[order], own[order]
    unique, begin = np.unique(g, return_index=True)
    return Index(items, edits, least, unique, np.append(begin, len(g)), own.astype(np.int32), (at - new[own]).astype(np.int32))


def all_grams(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(max(0, len(out) - Q + 1))
    if not len(at):
        return np.zeros(0, np.uint64), at
    sums = grams.prefix_sums(out)
    _, down = grams.powers(len(sums))
    return grams.mix((sums[Q:] - sums[:-Q]) * down[: len(at)]), at


def align(items: list[bytes], texts: list[bytes], low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits from each item to any part of its text that lies within the diagonals low ... low + width - 1, and that part's end."""
    n, longest = len(items), max(map(len, items))
    a = np.zeros((n, longest), np.uint8)
    size = np.array([len(x) for x in items])
    for r, x in enumerate(items):
        a[r, : len(x)] = np.frombuffer(x, np.uint8)
    span = longest + width
    b = np.full((n, span), 255, np.uint8)  # a byte that UTF-8 never has
    for r, (x, lo) in enumerate(zip(texts, low, strict=True)):
        part = np.frombuffer(x, np.uint8)[max(0, lo) : max(0, lo + span)]
        b[r, max(0, -lo) : max(0, -lo) + len(part)] = part[: span - max(0, -lo)]
    j = np.arange(width)
    d = np.zeros((n, width), np.int64)
    best, end = np.where(size[:, None] == 0, d, 0).min(1), low.copy()
    for i in range(longest):
        step = d + (b[:, i : i + width] != a[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(step - j, axis=1) + j
        done = np.flatnonzero(size == i + 1)
        if len(done):
            k = d[done].argmin(1)
            best[done], end[done] = d[done, k], k + low[done] + i + 1
    return best, end


class Finder:
    """Finds the items of an index in chunks of texts."""

    def __init__(self, ix: Index):
        self.ix = ix
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"ix": self.ix, "table": None}

    def candidates(self, out: np.ndarray, new: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first diagonal, end of diagonals) of neighbouring bands that reach their count."""
        ix, shift = self.ix, np.uint64(64 - FILTER_BITS)
        if self.table is None:
            self.table = np.zeros(1 << FILTER_BITS, bool)
            self.table[ix.gram >> shift] = True
        g, at = all_grams(out)
        at = at[self.table[g >> shift]]
        if not len(at):
            return
        g = g[at]
        k = np.minimum(np.searchsorted(ix.gram, g), len(ix.gram) - 1)
        hit = ix.gram[k] == g
        at, k = at[hit], k[hit]
        doc = np.searchsorted(new, at, side="right") - 1
        fit = at + Q <= new[doc + 1]
        at, k, doc = at[fit], k[fit], doc[fit]
        many = ix.begin[k + 1] - ix.begin[k]
        place = np.repeat(ix.begin[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        item = ix.item[place].astype(np.int64)
        step = ix.edits[item] + 1
        band = (at - new[doc] - ix.place[place]) // step
        pair = np.concatenate([doc * len(ix.items) + item] * 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((band, pair))
        pair, band = pair[order], band[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])) if len(pair) else np.zeros(0, int)
        count = np.diff(np.append(first, len(pair)))
        enough = first[count >= ix.least[pair[first] % len(ix.items)]]
        group: list[int] = []
        for p, x in zip(pair[enough].tolist(), band[enough].tolist(), strict=True):
            if group and p == group[0] and x <= group[2] + 1:
                group[2] = x
                continue
            if group:
                yield self.region(group)
            group = [p, x, x]
        if group:
            yield self.region(group)

    def region(self, group: list[int]) -> tuple[int, int, int, int]:
        doc, item = divmod(group[0], len(self.ix.items))
        step = int(self.ix.edits[item]) + 1
        return doc, item, group[1] * step, (group[2] + 2) * step

    def found(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, begin, end, edits): the bytes of the document where the item is, from the best of overlapping places."""
        if not len(self.ix.gram) or not data.size:
            return []
        out, new, at = plain(data, off)
        hits, rest = [], []
        for doc, item, lo, hi in self.candidates(out, new):
            text, x, k = out[new[doc] : new[doc + 1]].tobytes(), self.ix.items[item], int(self.ix.edits[item])
            lo, hi = lo - k, hi + k
            place = text.find(x, max(0, lo), max(0, hi + len(x)))
            if place >= 0:
                while place >= 0:
                    hits.append((doc, item, place, place + len(x), 0))
                    place = text.find(x, place + len(x), max(0, hi + len(x)))
            elif k:
                rest.append((doc, item, lo, hi, text))
        widest = max((r[3] - r[2] for r in rest), default=0)
        for part in range(0, len(rest), max(1, (4 << 20) // max(1, widest))):
            some = rest[part : part + max(1, (4 << 20) // max(1, widest))]
            items, texts = [self.ix.items[r[1]] for r in some], [r[4] for r in some]
            low = np.array([r[2] for r in some])
            best, end = align(items, texts, low, widest)
            for (doc, item, *_), x, text, edits, to in zip(some, items, texts, best.tolist(), end.tolist(), strict=True):
                k = int(self.ix.edits[item])
                if edits <= k:
                    back, begin = align([x[::-1]], [text[:to][::-1]], np.array([-k]), 2 * k + 1)
                    hits.append((doc, item, max(0, to - int(begin[0])), to, edits))
        best_of, last = [], None
        for hit in sorted(set(hits), key=lambda h: (h[0], h[1], h[2], h[4])):
            if last is not None and hit[:2] == last[:2] and hit[2] < last[3]:
                if hit[4] < last[4]:
                    best_of[-1] = last = hit
                continue
            best_of.append(hit)
            last = hit
        return [(d, i, int(at[new[d] + a] - off[d]), int(at[new[d] + b - 1] + 1 - off[d]), e) for d, i, a, b, e in best_of]


def indexes(bench: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, Index]]:
    """Ids and index of the items, ``most`` bytes of them at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    rows = bench.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        n = len(row["text"].encode())
        if texts and size + n > most:
            yield ids, index(texts)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += n
    if texts:
        yield ids, index(texts)


def find_items(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Each place where a document holds an item: ``doc_id, item_id, start, end, edits``; start and end count characters."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", bench.schema[item_id].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "end", "edits")])
    arrow = to_arrow_schema(schema)

    def finding(ids: list, ix: Index):
        finder = Finder(ix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for lo, _, data, off in grams.chunks(batch.column(text)):
                    for doc, item, begin, end, edits in finder.found(data, off):
                        head = data[off[doc] : off[doc] + end]
                        starts = (head & 0xC0) != 0x80  # of characters
                        rows.append((lo + doc, ids[item], int(starts[:begin].sum()), int(starts.sum()), edits))
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    columns = [batch.column(doc_id).take(pa.array(at)), *map(pa.array, rest)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return run

    source = docs.select(*dict.fromkeys([doc_id, text]))
    parts = [source.mapInArrow(finding(ids, ix), schema) for ids, ix in indexes(bench, item_id, text, max_index_bytes)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, bench: DataFrame, item_id: str = "item_id", text: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    name = free(docs.columns, "clean")

    def checking(ix: Index):
        finder = Finder(ix)

        def clean(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray]:
            ok = np.ones(len(off) - 1, bool)
            ok[[h[0] for h in finder.found(data, off)]] = False
            return (ok,)

        return clean

    for _, ix in indexes(bench, item_id, text, max_index_bytes):
        docs = text_columns(docs, text, [(name, T.BooleanType())], checking(ix), keep=name, drop=True)
    return docs
