"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods, with a penalised choice of languages.

Each language has a model of runs of three bytes (in lower case, other signs as one space), counted over every document that
is labelled with it, in one pass. A document is cut into runs of ``SEGMENT_WORDS`` words. Given a set of languages, its shares
of them are the weights of the mixture that generated the runs, estimated by expectation-maximisation. The set starts with the
best single language and grows by the language that raises the log likelihood most, as long as the rise is more than
log(runs) / 2 + ``PENALTY`` nats (the Bayesian information criterion, and a price for choosing among languages).

Defined cases: a null or empty text, or one without a letter or digit, has no language: empty lists and a null ``language``.
A null label, or a language that labels no text, has no model. Without any model no document has a language. Rows with the
same id are judged each by itself. Ties go to the language that is first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.llm import grams
from ferrograph.llm.decontaminate import plain
from ferrograph.llm.frames import free, text_columns

N = 3
BITS = 16
SEGMENT_WORDS = 8
PENALTY = 6.0
STEPS = 12
SMOOTH = 0.5
#: A language with a smaller share is not listed, though it may have been chosen.
LEAST_SHARE = 0.002


def gram_numbers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text in the compared form, its offsets, number of the gram at each place, and where grams stay within a document."""
    out, new, _ = plain(data, off)
    number = (grams.byte_grams(out, N) >> np.uint64(64 - BITS)).astype(np.int32)
    inside = np.ones(len(number), bool)
    for k in range(1, N):
        cut = new[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(number))]] = False
    return out, new, number, inside


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithms of their grams' probabilities, from all labelled documents."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi, data, off in grams.chunks(batch.column("text")):
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                names = sorted(set(langs))
                own = np.array([names.index(x) for x in langs])
                _, new, number, inside = gram_numbers(data, off)
                doc = np.repeat(np.arange(len(own)), np.diff(new))[: len(number)]
                found = np.bincount((own[doc] * size + number)[inside], minlength=len(names) * size).reshape(len(names), size)
                for name, row in zip(names, found, strict=True):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            gram = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram.astype(np.int32)), pa.array(row[gram])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), size), SMOOTH)
    for k, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[k, own["gram"].to_numpy()] += own["n"].to_numpy()
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def segments(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each run of words in each language, and the first run of each document (and an end)."""
    out, new, number, inside = gram_numbers(data, off)
    space = np.flatnonzero(out == 32)
    before = np.searchsorted(space, new)
    own = np.searchsorted(new, space, side="right") - 1
    cut = space[(np.arange(len(space)) - before[own]) % SEGMENT_WORDS == SEGMENT_WORDS - 1]
    full = new[:-1][new[1:] > new[:-1]]
    start = np.sort(np.concatenate([full, cut]))
    first = np.searchsorted(start, new)
    like = np.zeros((len(start), len(table)))
    if len(start) and len(number):
        edge = np.append(start, len(number))
        for k, row in enumerate(table):
            like[:, k] = grams.range_sums(np.where(inside, row[number], 0), edge[:-1], edge[1:])
    return like, first


def mixture(like: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's chosen languages, and its log likelihood, after ``STEPS`` steps."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    allowed = np.where(chosen[doc], like, -np.inf)
    top = allowed.max(1)
    p = np.exp(allowed - top[:, None])
    share = chosen / chosen.sum(1, keepdims=True)
    at = first[:-1]
    for step in range(STEPS + 1):
        parts = p * share[doc]
        whole = parts.sum(1)
        if step == STEPS:
            break
        share = np.add.reduceat(parts / whole[:, None], at) / n[:, None]
    return share, np.add.reduceat(np.log(whole) + top, at)


def choose(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each document's shares of the languages; it has a run at least."""
    n, count = np.diff(first), like.shape[1]
    single = np.add.reduceat(like, first[:-1])
    chosen = np.zeros((len(n), count), bool)
    chosen[np.arange(len(n)), single.argmax(1)] = True
    share, best = chosen.astype(float), single.max(1)
    price = np.log(n) / 2 + PENALTY
    # What a language can add at most: each run that it explains better goes to it alone.
    left = np.flatnonzero(n > 0)
    for _ in range(count - 1):
        doc = np.repeat(np.arange(len(n)), n)
        now = np.where(chosen[doc], like, -np.inf).max(1)
        most = np.add.reduceat(np.maximum(like - now[:, None], 0), first[:-1]) + (np.add.reduceat(now, first[:-1]) - best)[:, None]
        most[chosen] = -np.inf
        left = left[(most[left] > price[left, None]).any(1)]
        if not len(left):
            break
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first[left], first[left + 1], strict=True)])
        begin = np.concatenate([[0], np.cumsum(n[left])])
        rise, found = np.full((len(left), count), -np.inf), {}
        for k in range(count):
            with_k = chosen[left].copy()
            with_k[:, k] = True
            found[k], total = mixture(like[rows], begin, with_k)
            rise[:, k] = np.where(chosen[left, k], -np.inf, total - best[left])
        k = rise.argmax(1)
        up = rise[np.arange(len(left)), k] > price[left]
        left, k, gain = left[up], k[up], rise[up, k[up]] if up.any() else rise[:0, 0]
        if not len(left):
            break
        chosen[left, k] = True
        places = np.flatnonzero(up)
        share[left] = np.array([found[j][i] for i, j in zip(places, k, strict=True)])
        best[left] += gain
    return share


def identifier(names: list[str], table: np.ndarray) -> Callable:
    def identify(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
        docs = len(off) - 1
        langs: list[list[str]] = [[] for _ in range(docs)]
        shares: list[list[float]] = [[] for _ in range(docs)]
        if not names:
            return pa.array([None] * docs, pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), np.zeros(docs, np.int64)
        like, first = segments(data, off, table)
        n = np.diff(first)
        full = np.flatnonzero(n > 0)
        if len(full):
            share = choose(like, np.append(first[full], first[-1]))
            order = np.argsort(-share, axis=1, kind="stable")
            for d, row, by in zip(full.tolist(), share, order, strict=True):
                listed = [k for k in by if row[k] >= LEAST_SHARE]
                langs[d], shares[d] = [names[k] for k in listed], [round(float(row[k]), 4) for k in listed]
        return pa.array([x[0] if x else None for x in langs], pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), n

    return identify


def identify(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """All columns and rows of ``docs``, with ``language`` (of the largest share), ``languages``, ``shares`` and ``segments``."""
    kinds = (("language", T.StringType()), ("languages", T.ArrayType(T.StringType())), ("shares", T.ArrayType(T.DoubleType())), ("segments", T.LongType()))
    return text_columns(docs, text, [(free(docs.columns, n), t) for n, t in kinds], identifier(names, table))
