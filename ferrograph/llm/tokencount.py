"""Edit-aware token counts: a segment tree of pre-tokens for each document, of which edits change a few leaves.

A document's text is cut into pre-tokens by the tokenizer's pattern, and each pre-token is encoded by itself, so the number of
tokens is a sum over pre-tokens. The leaves of a document's tree hold the characters and tokens of its pre-tokens, and each
inner node the sums of its two. An edit begins to cut again at the leaf that holds the character two before it (an earlier
pre-token can't depend on what was edited, since the pattern looks at most two characters ahead) and stops where a new boundary
after the edit meets an old one (the pattern never looks back). The new pre-tokens go into the first leaf touched, the others
are emptied, and the sums above them are updated.

``with_trees`` keeps the trees in a table, and ``apply_edits`` takes such a table and edits: it encodes no more than the regions
that edits touch, and passes documents without edits on as they are. ``count_redacted`` and ``count_edited`` are for texts of
which no tree is kept.

The vocabulary is read where it lies; its path is a parameter. Counts are those of encoding the text as ordinary text.

Defined cases: a null or empty text has no pre-token and no token. Edits are applied one after the other, each to the text that
those before it left, in the order of their steps (ties by place, then replacement); places beyond the end mean the end, null
places the beginning, a null replacement nothing. Rows with the same id are counted each by itself, and get the same edits;
rows of a null id get none. Very long texts are taken whole, in time that grows with their length alone. Without rows there are
none in the result. Other columns pass through; where one has the name of a result column, ours gets underscores after its name.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm.frames import Sieve, free, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = regex.compile(PATTERN)
CONTEXT = 2
MAX_CACHED = 1 << 18

#: What is taken out of texts before they are counted as training data: (kind, pattern).
PERSONAL = (
    ("email", r"(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+"),
    ("secret", r"\b(?:sk|pk|ghp|AKIA|xox[bp])[-_A-Za-z0-9]{12,}\b|\b[0-9a-f]{32,}\b"),
    ("address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("phone", r"(?<!\w)\+?\d[\d ()./-]{7,16}\d(?!\w)"),
)
FIND = regex.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PERSONAL))
#: Found in every text in which ``FIND`` finds anything; in Arrow's linear syntax, which looks through a whole batch at once.
MAY_FIND = r"@|\p{Nd}[\p{Nd} ()./-]{7,16}\p{Nd}|\p{Nd}\.\p{Nd}|(?:sk|pk|ghp|AKIA|xox[bp])[-_A-Za-z0-9]{12}|[0-9a-f]{32}"


@functools.cache
def counter(vocabulary: str) -> Callable[[str], int]:
    """Tokens of a pre-token; those met before are looked up."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= MAX_CACHED:
                known.clear()
            n = known[piece] = len(encoding.encode_ordinary(piece))
        return n

    return count


class Tree:
    """Segment tree over pre-tokens; leaf k is node ``size + k``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        for sums, own in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.size : self.size + len(own)] = own
            half = self.size
            while half > 1:
                sums[half // 2 : half] = sums[half : 2 * half : 2] + sums[half + 1 : 2 * half : 2]
                half //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def to_bytes(self) -> bytes:
        return np.stack([self.chars[self.size : self.size + self.leaves], self.tokens[self.size : self.size + self.leaves]]).astype(np.int32).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        return cls(*np.frombuffer(raw, np.int32).reshape(2, -1))

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at``, and where it begins; at the end of the text one past the last leaf."""
        if at >= self.length:
            return self.leaves, self.length
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        more, extra = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (more or extra):
            self.chars[node] += more
            self.tokens[node] += extra
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str, count: Callable[[str], int]) -> tuple[str, int]:
        """The text with text[start:end] replaced, and how many pre-tokens had to be encoded."""
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        result, moved = text[:start] + new + text[end:], len(new) - (end - start)
        leaf, begin = self.find(max(0, start - CONTEXT))
        if leaf == self.leaves:  # behind the end of the text
            leaf, begin = self.find(max(0, self.length - 1)) if self.length else (0, 0)
        at, tokens, cut, stop = begin, 0, 0, self.leaves
        for match in CUT.finditer(result, begin):
            if at >= start + len(new):
                old, old_begin = self.find(at - moved)
                if old_begin == at - moved and old > leaf:
                    stop = old
                    break
            at = match.end()
            tokens += count(match[0])
            cut += 1
        for k in range(leaf + 1, stop):
            self.put(k, 0, 0)
        self.put(leaf, at - begin, tokens)
        return result, cut


def tree(text: str, count: Callable[[str], int]) -> Tree:
    pieces = CUT.findall(text)
    return Tree(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(count, pieces), np.int64, len(pieces)))


def may_be_personal(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, MAY_FIND), False).to_pylist()


def personal(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace personal data and secrets, from the last to the first."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in FIND.finditer(text)][::-1]


RESULT = (("pre_tokens", T.LongType()), ("tokens_before", T.LongType()), ("edits", T.LongType()), ("encoded_again", T.LongType()), ("tokens_after", T.LongType()))


def counted(rows: DataFrame, text: str, keep: list[str], edits_of: Callable[[pa.RecordBatch], Iterator], vocabulary: str, taken: list[str]) -> DataFrame:
    names = []
    for n, _ in RESULT:
        names.append(free([*taken, *names], n))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, t) for n, (_, t) in zip(names, RESULT, strict=True)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            out = []
            for value, edits in zip(batch.column(text), edits_of(batch), strict=True):
                now = value.as_py() or ""
                own = tree(now, count)
                before, again, n, pieces = own.total, 0, 0, own.leaves if now else 0
                for start, end, new in edits(now) if callable(edits) else edits:
                    now, cut = own.edit(now, start, end, new, count)
                    again += cut
                    n += 1
                out.append((pieces, before, n, again, own.total))
            if out:
                columns = [batch.column(c) for c in keep] + [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def count_redacted(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with the counts before and after personal data and secrets are taken out."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, text]))

    def of(batch: pa.RecordBatch) -> Iterator:
        yield from (personal if some else () for some in may_be_personal(batch.column(text)))

    return counted(rows, text, keep, of, vocabulary, docs.columns)


def edit_lists(edits: DataFrame, id_col: str, key: str, name: str) -> DataFrame:
    """(key, name): each document's edits, in order."""
    row = F.struct("step", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("replacement", F.lit("")).alias("new"))
    return edits.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_list(row)).alias(name))


def edits_in(column: pa.Array) -> Iterator[list[tuple[int, int, str]]]:
    for x in column:
        yield [(e["start"] or 0, e["end"] or 0, e["new"]) for e in x.as_py() or []]


def count_edited(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of docs with the counts before and after ``edits`` (id, step, start, end, replacement), applied by step."""
    name, key = free(docs.columns, "edit_list"), free(docs.columns, "edit_id")
    rows = docs.join(edit_lists(edits, id_col, key, name), F.col(id_col) == F.col(key), "left").drop(key)
    return counted(rows, text, docs.columns, lambda batch: edits_in(batch.column(name)), vocabulary, rows.columns)


def apply_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text: str = "text", tree: str = "token_tree", tokens: str = "token_count", vocabulary: str = VOCABULARY) -> DataFrame:
    """A table of ``with_trees`` after ``edits`` (id, step, start, end, replacement): new text, tree and count, and ``encoded_again``, how many pre-tokens had to be encoded.

    Only documents that may have edits are joined with them, and only those with edits are read.
    """
    name, key, again = free(docs.columns, "edit_list"), free(docs.columns, "edit_id"), free(docs.columns, "encoded_again")
    lists = staged(edit_lists(edits.select(id_col, "step", "start", "end", "replacement"), id_col, key, name), "edits")
    maybe = Sieve.of(lists.select(F.xxhash64(key).alias("h")), "h").may_have(F.xxhash64(id_col))
    rows = docs.filter(maybe).join(lists, F.col(id_col) == F.col(key), "left").drop(key)
    schema = T.StructType([*docs.schema.fields, T.StructField(again, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            out = []
            for now, raw, edits in zip(batch.column(text).to_pylist(), batch.column(tree), edits_in(batch.column(name)), strict=True):
                own, cut, now = Tree.from_bytes(raw.as_buffer().to_pybytes()), 0, now or ""
                for start, end, new in edits:
                    now, n = own.edit(now, start, end, new, count)
                    cut += n
                out.append((now, own.to_bytes(), own.total, cut))
            if out:
                new = dict(zip((text, tree, tokens, again), (pa.array(c) for c in zip(*out, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([(new[f.name] if f.name in new else batch.column(f.name)).cast(f.type) for f in arrow], schema=arrow)

    done = rows.filter(F.col(name).isNotNull()).mapInArrow(run, schema)
    same = lambda df: df.select(*docs.columns, F.lit(0).cast("long").alias(again))
    return same(docs.filter(~maybe)).unionByName(same(rows.filter(F.col(name).isNull()))).unionByName(done)


def with_trees(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of docs with ``token_tree``, the leaves of each document's tree, and ``token_count``, to be kept in a table."""
    fields = [T.StructField(free(docs.columns, "token_tree"), T.BinaryType()), T.StructField(free(docs.columns, "token_count"), T.LongType())]
    schema = T.StructType([*docs.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            trees = [tree(x.as_py() or "", count) for x in batch.column(text)]
            new = [pa.array([t.to_bytes() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *new], arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)
