"""Quality rules: a hashed word and character n-gram logistic regression with calibrated probabilities and fixed thresholds.

The features of a document are the shares of its hashed words, word pairs and runs of four bytes; a pair of twice the same
word counts as one feature of its own. Weights are fitted on at most ``MAX_TRAIN_ROWS`` labelled documents (those with the
smallest hashes of their ids), probabilities are calibrated on a quarter of them that the fit doesn't see, and every document
is scored over its whole text in one Arrow pass without a shuffle.

Defined cases: a null or empty text, or one without any feature, has probability 0 and is rejected. Rows with the same id are
scored each by itself. A label of a repeated id counts once, as the worse one, with the smallest of the id's texts; null labels
count for nothing. Equal probabilities are treated alike; one at a threshold is kept. Very long texts are scored whole. An empty
table stays empty. Without labels
of both kinds nothing can be told apart, and all texts that aren't empty are kept, with probability 1. Other columns pass
through; if one has the name of a result column, ours gets underscores after its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.llm import grams, linear
from ferrograph.llm.frames import free, text_columns

BITS = 18
CHAR_N = 4
#: At most so many labelled documents are fitted and calibrated on.
MAX_TRAIN_ROWS = 4000
#: Documents with a smaller probability of being of good quality are rejected.
REJECT_BELOW = 0.35
#: From here up the rating is "high", between the two thresholds it is "fair".
HIGH_FROM = 0.9
SAME_PAIR = np.uint64(0x5EED)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float
    bits: int = BITS


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, pairs and byte runs: feature numbers, and from where to where those of each document lie."""
    shift, docs = np.uint64(64 - bits), np.arange(len(off) - 1)
    h, doc = grams.words(data, off)
    yield (h >> shift).astype(np.int64), np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")
    g, at = grams.word_grams(h, doc, 2)
    if len(g):
        same = (h[:-1] == h[1:])[doc[:-1] == doc[1:]]
        g = np.where(same, SAME_PAIR, g)
    yield (g >> shift).astype(np.int64) + (1 << bits), np.searchsorted(at, docs), np.searchsorted(at, docs, side="right")
    lo, hi = grams.gram_ends(off, CHAR_N)
    yield (grams.byte_grams(data, CHAR_N) >> shift).astype(np.int64) + (2 << bits), lo, hi


def rows(texts: list[str], bits: int = BITS) -> linear.Rows:
    sizes, idx, val = [], [], []
    for text in texts:
        data, off = grams.text_bytes(pa.array([text], pa.large_string()))
        f, v = [], []
        for numbers, lo, hi in features(data, off, bits):
            own, n = np.unique(numbers[lo[0] : hi[0]], return_counts=True)
            f.append(own)
            v.append(n / max(1, n.sum()))
        idx.append(np.concatenate(f).astype(np.int32))
        val.append(np.concatenate(v).astype(np.float32))
        sizes.append(len(idx[-1]))
    none = np.zeros(0, np.int32)
    return linear.Rows(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([none, *idx]), np.concatenate([none.astype(np.float32), *val]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, most: int) -> list:
    """(text, label) of at most ``most`` labelled documents, in an order that doesn't depend on partitions."""
    key, y = "id", "y"
    chosen = (
        labels.select(F.col(id_col).alias(key), F.col(label).cast("int").alias(y)).filter(F.col(key).isNotNull() & F.col(y).isNotNull())
        .groupBy(key).agg(F.min(y).alias(y)).orderBy(F.xxhash64(key), key).limit(most)
    )
    texts = docs.select(F.col(id_col).alias(key), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), key).groupBy(key, y).agg(F.min("text").alias("text")).collect()  # chosen has at most ``most`` rows, and so has the result
    return sorted((r["id"], r["text"], r["y"]) for r in found)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> Model | None:
    """A calibrated model, or None where the labels are all of one kind."""
    got = sample(docs, labels, id_col, text, label, max_train_rows)
    y = np.array([min(1, max(0, r[2])) for r in got], float)
    if len(set(y)) < 2:
        return None
    x = rows([r[1] for r in got], bits)
    held = np.array([hash_share(r[0]) < 0.25 for r in got])
    if any(len(set(y[m])) < 2 for m in (held, ~held)):
        held[:] = False
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))  # both kinds count alike
    own = np.flatnonzero(~held)
    test = np.flatnonzero(held) if held.any() else own
    fitted, tested = x.some(own), x.some(test)
    del x
    w, b = linear.fit(fitted, y[own], weight[own], 3 << bits, steps=60, rate=1.0, l2=1e-7)
    slope, offset = linear.platt(tested.times(w) + b, y[test])
    return Model(w.astype(np.float32), b, slope, offset, bits)


def hash_share(key: object) -> float:
    h = np.array([hash(key) & 0xFFFFFFFF if isinstance(key, int) else sum(map(ord, str(key)))], np.uint64)
    return float(grams.mix(h * np.uint64(grams.BASE))[0] >> np.uint64(40)) / (1 << 24)


def scorer(model: Model | None, reject_below: float, high_from: float) -> Callable:
    def score(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = off[1:] > off[:-1]
        if model is None:
            p = full.astype(float)
        else:
            total, any_feature = np.full(len(off) - 1, model.bias), np.zeros(len(off) - 1, bool)
            for numbers, lo, hi in features(data, off, model.bits):
                n = hi - lo
                total += grams.range_sums(model.weights[numbers], lo, hi) / np.maximum(1, n)
                any_feature |= n > 0
            p = np.where(full & any_feature, linear.sigmoid(model.a * total + model.b), 0.0)
        keep = p >= reject_below
        return np.round(p, 6), np.where(p >= high_from, "high", np.where(keep, "fair", "rejected")), keep

    return score


def rate(docs: DataFrame, model: Model | None, text: str = "text", reject_below: float = REJECT_BELOW, high_from: float = HIGH_FROM) -> DataFrame:
    """All columns and rows of ``docs``, with ``quality_probability``, ``quality_rating`` and ``quality_keep``."""
    fields = [(free(docs.columns, n), t) for n, t in (("quality_probability", T.DoubleType()), ("quality_rating", T.StringType()), ("quality_keep", T.BooleanType()))]
    return text_columns(docs, text, fields, scorer(model, reject_below, high_from))


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns alone."""
    names = [free(docs.columns, n) for n in ("quality_probability", "quality_rating", "quality_keep")]
    fields = list(zip(names, (T.DoubleType(), T.StringType(), T.BooleanType()), strict=True))
    return text_columns(docs, text, fields, scorer(model, reject_below, HIGH_FROM), keep=names[2], drop=True)
