"""Line dedup: a tree of line templates of fixed depth; templates that recur across documents are dropped.

A line's leaf is given by its number of tokens and its first ``LEAD`` tokens; a token with a digit counts as a variable field.
Within a leaf, lines form templates: from the most common to the rarest (ties by their tokens), a line joins the template that
it equals in most of the tokens after the leading ones, if that is ``SIMILAR`` of them at least (ties: the older template), and
fields where they differ become variable; else it starts a template. Lines that can match are found by pieces of which one at
least must be equal, so that a leaf takes about linear time.

A template recurs if it is in enough documents, where copies of one document count as one: they are no evidence of
boilerplate, and belong to near-duplicate removal. Copies are told by what the documents hold besides the line: every line has a
sketch of all lines of its document that are in other leaves, so that what a template itself makes alike doesn't count. The sketch
has, for each of ``BINS`` ranges of hashes, four bits of the smallest hash there of two words in a row within a line. A document is
a copy if it agrees with the first of some copies in ``COPY`` of the bins that either uses, or with one of the next ``KIN_KEPT`` in
``KIN`` of them. A document with under ``OUTSIDE`` of its words in other leaves is
a near copy of any other such one, and counts for nothing. Enough are ``MIN_DOCS`` for lines of up to ``CHANCE`` tokens, which
repeat by chance, and the fewer the longer the line, down to two from ``CHANCE * MIN_DOCS / 2`` tokens on (40). To go with fewer
than ``MIN_DOCS``, only documents with ``FIRM`` of their words in other leaves count, as edits can make less than that unlike. Of a recurring template the first line stays (by document id, then
place) with the texts equal to its own; all others go.

Each task first sums up the lines that are equal but for variable fields: how many there are, their first place, and the sketches
that tell whether they recur. Of more than ``FEW_SKETCHES`` those go that add no evidence, and all once the line is certain to
recur. Only these sums travel, sorted by leaf, so that a line that a third of all documents hold is one row from each task. The
masked lines of recurring templates come back; a second look at the texts finds their places, which a join settles exactly, in
``SALTS`` parts of each line. Only texts that lose lines are shuffled.

Defined cases: null texts stay null and empty texts empty. Lines of white space alone are never dropped. Rows with the same id
or text are treated alike; a text is known by 96 bits of hashes. Null ids come last. Very long texts and lines are taken whole, and an
empty table gives an empty one. Other columns pass through; result columns of a name that is there already get
underscores after theirs.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm import grams
from ferrograph.llm.frames import Sieve, free, staged
from ferrograph.llm.jaccard import groups

LEAD = 3
SIMILAR = 0.75
MIN_DOCS = 8
CHANCE = 10
SKETCH_WORDS = 2
BINS = 64
COPY = 0.4
KIN = 0.5
KIN_KEPT = 64
#: Sketches of a line that a task gathers before it drops those that add nothing, and masked lines and their characters that it holds before it sends them.
FEW_SKETCHES = 96
HELD = 16_000
HELD_CHARS = 1 << 22
SALTS = 8
WIDTH = BINS // 2 + 1
OUTSIDE = 0.1
FIRM = 0.25
#: Lines and rows whose sketches are unpacked at a time.
BLOCK = 1 << 10
FIELD = "<*>"
DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    return [FIELD if DIGIT.search(t) else t for t in line.split()] if DIGIT.search(line) else line.split()


def leaf(tokens: list[str], lead: int) -> int:
    return xxhash.xxh64_intdigest(f"{len(tokens)} {' '.join(tokens[:lead])}") - (1 << 63)


def line_hash(line: str) -> tuple[int, int]:
    """128 bits of a masked line."""
    return xxhash.xxh64_intdigest(line) - (1 << 63), xxhash.xxh3_64_intdigest(line) - (1 << 63)


def templates(lines: dict[tuple[str, ...], int], lead: int, similar: float) -> list[list[tuple[str, ...]]]:
    """The masked lines of one leaf, with their counts, by template."""
    out: list[list[tuple[str, ...]]] = []
    pattern: list[list[str]] = []
    pieces: dict[tuple, list[int]] = defaultdict(list)
    n = len(next(iter(lines))) - lead
    if n <= 0:
        return [[x] for x in sorted(lines)]
    need = int(np.ceil(similar * n - 1e-9))
    parts = n - need + 1
    cuts = [k * n // parts for k in range(parts + 1)]
    for line in sorted(lines, key=lambda x: (-lines[x], x)):
        rest = line[lead:]
        own = [(k, rest[cuts[k] : cuts[k + 1]]) for k in range(parts)]
        best, most = -1, need - 1
        for t in sorted({t for key in own for t in pieces.get(key, ())}):
            equal = sum(a == b and b != FIELD for a, b in zip(rest, pattern[t], strict=True))
            if equal > most:
                best, most = t, equal
        if best < 0:
            best = len(out)
            out.append([])
            pattern.append(list(rest))
            for key in own:
                pieces[key].append(best)
        elif most < n:
            pattern[best] = [a if a == b else FIELD for a, b in zip(rest, pattern[best], strict=True)]
        out[best].append(line)
    return out


def line_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every run of words within a line, of a short line's words together, and each line's number of words."""
    h, line = grams.words(data, bounds)
    g, at = grams.word_grams(h, line, SKETCH_WORDS)
    count = np.bincount(line, minlength=len(bounds) - 1)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < SKETCH_WORDS))
    few = np.zeros(len(short), np.uint64)
    for k in range(SKETCH_WORDS - 1):
        has = count[short] > k
        few[has] = few[has] * np.uint64(grams.BASE) + h[begin[short[has]] + k]
    return np.concatenate([g, grams.mix(few)]), np.concatenate([at, short]), count


def outside(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, leaves: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the lines in rows, packed sketches of their documents without the lines of their leaf, and whether these are firm. doc, leaves: of all lines."""
    g, line, count = line_grams(data, bounds)
    slot = doc[line] * BINS + (g >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    size = (int(doc[-1]) + 1) * BINS
    none = np.uint64(2**64 - 1)
    least, other, owner = np.full(size, none), np.full(size, none), np.zeros(size, np.int64)
    np.minimum.at(least, slot, g)
    own = leaves[line]
    first = g == least[slot]
    owner[slot[first]] = own[first]
    rest = own != owner[slot]
    np.minimum.at(other, slot[rest], g[rest])
    least, other = (np.where(x == none, 0, 1 + x % np.uint64(15)).astype(np.uint8).reshape(-1, BINS) for x in (least, other))
    owner = owner.reshape(-1, BINS)
    order = np.lexsort((leaves, doc))  # words by document and leaf
    begin = np.flatnonzero(np.append(True, (doc[order][1:] != doc[order][:-1]) | (leaves[order][1:] != leaves[order][:-1])))
    inside = np.empty(len(doc), np.int64)
    inside[order] = np.repeat(np.add.reduceat(count[order], begin), np.diff(np.append(begin, len(doc))))
    whole = np.bincount(doc, count)[doc]
    out = []
    for lo in range(0, len(rows), BLOCK):
        r = rows[lo : lo + BLOCK]
        sketch = np.where(owner[doc[r]] == leaves[r, None], other[doc[r]], least[doc[r]])
        sketch[whole[r] - inside[r] < OUTSIDE * whole[r]] = 0
        firm = whole[r] - inside[r] >= FIRM * whole[r]
        out.append(np.column_stack([sketch[:, ::2] << 4 | sketch[:, 1::2], firm.astype(np.uint8)]))
    return np.concatenate(out)


def agree(rows: np.ndarray, one: np.ndarray, share: float) -> np.ndarray:
    return ((rows == one) & (one > 0)).sum(1) >= share * ((rows > 0) | (one > 0)).sum(1)


def clusters(packed: np.ndarray, most: int) -> list[list[int]]:
    """Rows that stand for documents which are no copies of those before, up to ``most``, each with those by which its copies are told."""
    found: list[list[np.ndarray]] = []
    rows: list[list[int]] = []
    for lo in range(0, len(packed), BLOCK):
        rest = np.stack([packed[lo : lo + BLOCK] >> 4, packed[lo : lo + BLOCK] & 15], 2).reshape(-1, BINS)
        at = lo + np.flatnonzero(rest.any(1))
        rest, k = rest[at - lo], 0
        while len(rest):
            if k == len(found):
                found.append([rest[0]])
                rows.append([int(at[0])])
                if len(found) == most:
                    return rows
            kin = found[k]
            near = agree(rest, kin[0], COPY)
            room = KIN_KEPT + 1 - len(kin)
            kin += list(rest[near][:room])
            rows[k] += at[near][:room].tolist()
            rest, at = rest[~near], at[~near]
            for one in kin[1:]:
                if not len(rest):
                    break
                other = ~agree(rest, one, KIN)
                rest, at = rest[other], at[other]
            k += 1
    return rows


def evidence(sketch: np.ndarray, need: int, min_docs: int) -> tuple[bool, list[int]]:
    """Whether documents with these sketches make a template recur, and if they don't, the rows that can help to show that it does."""
    firm = np.flatnonzero(sketch[:, -1])
    of_firm = clusters(sketch[firm, :-1], need)
    if len(of_firm) >= need:
        return True, []
    of_all = clusters(sketch[:, :-1], min_docs)
    if len(of_all) >= min_docs:
        return True, []
    return False, sorted({int(firm[k]) for c in of_firm for k in c}.union(*of_all))


def enough(tokens: int, min_docs: int) -> int:
    """The number of documents in which a template of so many tokens recurs."""
    return min(min_docs, max(2, -(-CHANCE * min_docs // tokens)))


class Line:
    """What is known of a masked line: its number of rows, the first of them, and sketches by text."""

    __slots__ = ("certain", "count", "first", "leaf", "most", "need", "sketches")

    def __init__(self, leaf: int, need: int) -> None:
        self.leaf, self.need, self.count, self.certain, self.most = leaf, need, 0, False, FEW_SKETCHES
        self.first: tuple = ()
        self.sketches: dict[tuple[int, int], bytes] = {}

    def add(self, count: int, first: tuple, sketches: dict[tuple[int, int], bytes], certain: bool, min_docs: int) -> None:
        self.count += count
        if not self.first or first < self.first:
            self.first = first
        if self.certain or certain:
            self.certain, self.sketches = True, {}
            return
        self.sketches.update(sketches)
        if len(self.sketches) > self.most:
            self.settle(min_docs)
            self.most = len(self.sketches) + FEW_SKETCHES

    def settle(self, min_docs: int) -> None:
        """Find whether the line is certain to recur by itself, and drop the sketches that add nothing."""
        keys = sorted(self.sketches)
        self.certain, left = evidence(rows_of([self.sketches[k] for k in keys]), self.need, min_docs)
        self.sketches = {keys[k]: self.sketches[keys[k]] for k in left}


def rows_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, WIDTH)


def line_rows(docs: DataFrame, lead: int, min_docs: int) -> DataFrame:
    """What each task knows of each masked line that it holds; ``id``, ``number``, ``key`` and ``key2`` are of the first row. docs: (id, key, key2, text)."""
    plain = (("leaf", T.LongType()), ("line", T.StringType()), ("rows", T.LongType()), ("number", T.IntegerType()), ("key", T.LongType()), ("key2", T.LongType()), ("certain", T.BooleanType()), ("texts", T.BinaryType()), ("sketches", T.BinaryType()))
    schema = T.StructType([*(T.StructField(*f) for f in plain), docs.schema["id"]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Line] = {}
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            some = list(held.items())
            for k in range(0, len(some), 2000):
                lines, own = zip(*some[k : k + 2000], strict=True)
                for x in own:
                    if len(x.sketches) > FEW_SKETCHES:
                        x.settle(min_docs)
                columns = [
                    [x.leaf for x in own], lines, [x.count for x in own], [x.first[2] for x in own], [x.first[3] for x in own], [x.first[4] for x in own], [x.certain for x in own],
                    [b"".join([struct.pack("<qq", *k) for k in x.sketches]) for x in own], [b"".join(x.sketches.values()) for x in own], [None if x.first[0] else x.first[1] for x in own],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            held.clear()

        for batch in batches:
            ids, keys, others = (batch.column(n).to_pylist() for n in ("id", "key", "key2"))
            for lo, hi, data, off in grams.chunks(batch.column("text")):
                bounds = np.sort(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
                at, leaves, numbers, lines, sizes, rows = [], [], [], [], [], []
                for d, text in enumerate(batch.column("text").slice(lo, hi - lo).to_pylist()):
                    for k, line in enumerate(text.split("\n")):
                        tokens = masked(line)
                        at.append(d)
                        leaves.append(leaf(tokens, lead) if tokens else 0)
                        if tokens:
                            rows.append(len(at) - 1)
                            numbers.append(k)
                            lines.append(" ".join(tokens))
                            sizes.append(len(tokens))
                if not rows:
                    continue
                at, leaves, rows = np.array(at), np.array(leaves, np.int64), np.array(rows)
                packed = outside(data, bounds, at, leaves, rows)
                told, raw = packed[:, :-1].any(1).tolist(), packed.tobytes()
                for k, (d, number, line, size, of) in enumerate(zip((at[rows] + lo).tolist(), numbers, lines, sizes, leaves[rows].tolist(), strict=True)):
                    own, key = held.get(line), (keys[d], others[d])
                    first, sketch = place(ids[d], number, *key), {key: raw[k * WIDTH : (k + 1) * WIDTH]} if told[k] else {}
                    if own is None:
                        own = held[line] = Line(of, enough(size, min_docs))
                        own.count, own.first, own.sketches = 1, first, sketch
                        chars += len(line)
                    else:
                        own.add(1, first, sketch, False, min_docs)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield from flush()
                    chars = 0
        yield from flush()

    return docs.filter(F.col("text").isNotNull()).mapInArrow(run, schema)


def place(id: object, number: int, key: int, key2: int) -> tuple:
    """By which the first of some rows is told."""
    return id is None, 0 if id is None else id, number, key, key2


def recurring(lines: DataFrame, lead: int, similar: float, min_docs: int) -> DataFrame:
    """(h, h2) of the masked lines of recurring templates, with text and number of the line that stays."""
    names = ["h", "h2", "kept_key", "kept_key2", "kept_number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "leaf"):
            leaves = table["leaf"].to_numpy()
            first = np.append(np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])), len(leaves))
            certain, rows, size = table["certain"].to_numpy(), table["rows"].to_numpy(), pc.binary_length(table["sketches"]).to_numpy() // WIDTH
            out: list[tuple] = []
            whole = lambda x: np.add.reduceat(x.astype(np.int64), first[:-1])
            certainly, evident = whole(certain), whole(size)
            some = (whole(rows) >= min(2, min_docs)) & ((certainly > 0) | (evident >= min(2, min_docs)))
            for k in np.flatnonzero(some).tolist():
                a, z = int(first[k]), int(first[k + 1])
                need = enough(table["line"][a].as_py().count(" ") + 1, min_docs)
                if not certainly[k] and evident[k] < need:
                    continue
                known: dict[str, Line] = {}
                for r in table.slice(a, z - a).to_pylist():
                    texts = np.frombuffer(r["texts"], np.int64).reshape(-1, 2).tolist()
                    own = {(x, y): r["sketches"][k * WIDTH : (k + 1) * WIDTH] for k, (x, y) in enumerate(texts)}
                    known.setdefault(r["line"], Line(int(leaves[a]), need)).add(r["rows"], place(r["id"], r["number"], r["key"], r["key2"]), own, r["certain"], min_docs)
                for members in templates({tuple(line.split(" ")): own.count for line, own in known.items()}, lead, similar):
                    text = [" ".join(m) for m in members]
                    own = [known[m] for m in text]
                    sketches = {k: x for one in own for k, x in one.sketches.items()}
                    if any(one.certain for one in own) or len(sketches) >= need and evidence(rows_of([sketches[k] for k in sorted(sketches)]), need, min_docs)[0]:
                        kept = min(one.first for one in own)
                        out += [(*line_hash(m), kept[3], kept[4], kept[2]) for m in text]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return lines.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def places(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """(key, key2, number, h, h2) of the lines that may be among some, by their hashes, once from each batch. docs: (key, key2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, rows, lines = set(), [], []
            for key, key2, text in zip(*(batch.column(n).to_pylist() for n in ("key", "key2", "text")), strict=True):
                if (key, key2) not in seen:
                    seen.add((key, key2))
                    for k, line in enumerate(text.split("\n")):
                        if tokens := masked(line):
                            rows.append((key, key2, k))
                            lines.append(" ".join(tokens))
            if rows:
                h = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64) ^ np.uint64(1 << 63)
                found = [(*rows[k], *line_hash(lines[k])) for k in np.flatnonzero(wanted.has(h)).tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["key", "key2", "number", "h", "h2"])

    return docs.filter(F.col("text").isNotNull()).mapInArrow(run, "key long, key2 long, number long, h long, h2 long")


def drops(docs: DataFrame, lead: int, similar: float, min_docs: int) -> DataFrame:
    """(key, key2, numbers) of the lines to drop. docs: (id, key, key2, text)."""
    lines = staged(recurring(line_rows(docs, lead, min_docs), lead, similar, min_docs), "templates")
    at = places(docs.select("key", "key2", "text"), Sieve.of(lines.select("h"), "h")).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    spread = lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = at.join(spread.hint("merge"), ["h", "h2", "salt"])
    found = found.filter((F.col("key") != F.col("kept_key")) | (F.col("key2") != F.col("kept_key2")) | (F.col("number") != F.col("kept_number")))
    return found.groupBy("key", "key2").agg(F.collect_set(F.col("number").cast("int")).alias("numbers"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows of ``docs`` with the recurring lines gone from ``text``, and ``dropped_lines``, how many."""
    names = docs.columns
    key, key2, gone, count = (free(names, n) for n in ("text_key", "text_key2", "gone_lines", "dropped_lines"))
    one, two = F.xxhash64(text), F.hash(text).cast("long")
    found = drops(docs.select(F.col(id_col).alias("id"), one.alias("key"), two.alias("key2"), F.col(text).alias("text")), lead, similar, min_docs)
    found = staged(found.select(F.col("key").alias(key), F.col("key2").alias(key2), F.col("numbers").alias(gone)), "lines")
    may = F.col(text).isNotNull() & Sieve.of(found.select(F.col(key).alias("h")), "h").may_have(one)
    touched = docs.filter(may).withColumn(key, one).withColumn(key2, two).join(found.hint("merge"), [key, key2], "left")  # one plan at every size; the parts of a text that many rows hold are split by Spark
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    columns = [new.alias(n) if n == text else F.col(n) for n in names]
    changed = touched.select(*columns, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(count))
    return docs.filter(~may).withColumn(count, F.lit(0)).unionByName(changed)


def drop_lines_and_blank(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``drop_lines`` with the columns of ``docs``, without the documents of which nothing but white space is left."""
    out = drop_lines(docs, id_col, text, **settings)
    count = out.columns[-1]
    return out.filter((F.col(count) == 0) | F.col(text).rlike(r"\S")).select(*docs.columns)
