"""Mixing sources to target weights by entropy balancing.

Each document i with t_i tokens gets a rate r_i, the expected number of its copies. Of all rates that meet the constraints
those are taken that are nearest to 1 in the entropy sum over i of t_i (r_i log r_i - r_i + 1), in which every token counts
alike. The constraints: each source has its target share of all tokens; each language keeps its share; and the mean logarithm
of document length, by tokens, stays as it is. The convex dual makes rates exponentially tilted: r_i = exp(a[source] + b[lang]
+ c z_i), with z_i the standardised logarithm of the length. Newton's method solves the dual; every step sums gradient
and Hessian over all documents in one distributed aggregation, and is halved while the dual doesn't fall.

Rates become copies by rounding up or down with a probability that keeps the mean, decided by a hash of the row; documents
with no copy go, the others carry their number of copies.

Sources have the target weight given, or by default their number of tokens to the power of ``TEMPER``. If the constraints
can't all be met (a language of one source alone, say), the ridge term ``RIDGE`` spreads what is missing.

Defined cases: a null source or language is a source or language of its own. A source without a given target has weight 0, and
its documents the rate 0. Null and empty texts have no tokens: they weigh nothing, and take the rate that a text of their
source, language and length has. Without any token all rates are 1. Repeated rows are rounded alike. Very long texts are
counted whole. An empty table stays empty. Other columns pass through; where one has the name of a result column, ours gets
underscores after its name. The rates are bounded by the number of pairs of source and language, not of rows: over ``MAX_CELLS``
of these (hosts as sources, say) are refused with an error, as the dual's matrices wouldn't fit the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm import grams
from ferrograph.llm.frames import batch_kernel, free, staged, text_columns

TEMPER = 0.5
RIDGE = 1e-7
STEPS = 30
PRECISION = 1e-7
#: Where the dual ends with a larger gradient, a warning says so, and ``Rates.residual`` has it.
TOLERANCE = 1e-4
#: Sources and languages are told apart as they are up to so many cells of both; the driver's matrices hold that many rows.
MAX_CELLS = 20_000


def token_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray]:
    _, _, doc = grams.spans(data, off)
    return (np.bincount(doc, minlength=len(off) - 1).astype(np.int64),)


@dataclass
class Rates:
    """Dual solution: one row for each source and language."""

    cells: list[tuple]
    shift: np.ndarray
    slope: float
    mean: float
    scale: float
    shares: dict
    residual: float = 0.0

    def column(self, tokens: Column) -> Column:
        return F.least(F.greatest(self.slope * (F.log1p(tokens) - self.mean) / self.scale, F.lit(-60.0)), F.lit(60.0))


def solve(stats: DataFrame, weights: dict | None, temper: float = TEMPER) -> Rates:
    """Newton's method on the dual. stats: (source, lang, t)."""
    z0 = F.log1p("t")
    t = F.col("t").cast("double")
    first = stats.groupBy("source", "lang").agg(F.sum(t).alias("w"), F.sum(t * z0).alias("wz"), F.sum(t * z0 * z0).alias("wzz")).limit(MAX_CELLS + 1).collect()
    if len(first) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} pairs of source and language; group sources first")
    cells = sorted(((r["source"], r["lang"]) for r in first), key=lambda c: tuple((x is None, x or "") for x in c))
    at = {c: k for k, c in enumerate(cells)}
    base = np.zeros((len(cells), 3))
    for r in first:
        base[at[r["source"], r["lang"]]] = r["w"], r["wz"], r["wzz"]
    total = base[:, 0].sum()
    if not total:
        return Rates(cells, np.zeros(len(cells)), 0.0, 0.0, 1.0, {})
    mean = base[:, 1].sum() / total
    scale = float(np.sqrt(max(base[:, 2].sum() / total - mean * mean, 0))) or 1.0
    sources, langs = list(dict.fromkeys(c[0] for c in cells)), sorted({c[1] for c in cells}, key=lambda x: (x is None, x or ""))
    s_of, l_of = np.array([sources.index(c[0]) for c in cells]), np.array([langs.index(c[1]) for c in cells])
    tokens = np.bincount(s_of, weights=base[:, 0], minlength=len(sources))
    aim = tokens**temper if weights is None else np.array([max(0.0, float(weights.get(s) or 0.0)) for s in sources])
    aim = np.where(tokens > 0, aim, 0)
    aim = aim / aim.sum() if aim.sum() else tokens / total
    out = aim[s_of] <= 0
    lang_aim = np.bincount(l_of, weights=np.where(out, 0, base[:, 0]), minlength=len(langs))
    lang_aim = lang_aim / lang_aim.sum()
    size = len(sources) + len(langs) + 1
    design = np.zeros((len(cells), size))
    design[np.arange(len(cells)), s_of] = 1
    design[np.arange(len(cells)), len(sources) + l_of] = 1
    target = np.concatenate([aim, lang_aim, [0.0]])
    x = np.zeros(size)
    x[: len(sources)] = np.log(np.maximum(aim, 1e-300) / np.maximum(tokens / total, 1e-300)) * (aim > 0)

    def sums(slope: float) -> np.ndarray:
        """Over each cell: tokens, tokens z and tokens z z, tilted by the slope."""
        z = (F.log1p("t") - mean) / scale
        w = t * F.exp(F.least(F.greatest(slope * z, F.lit(-60.0)), F.lit(60.0))) / total
        found = np.zeros((len(cells), 3))
        for r in stats.groupBy("source", "lang").agg(F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz")).collect():
            found[at[r["source"], r["lang"]]] = r["w"], r["wz"], r["wzz"]
        return found

    def dual(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cell = sums(float(x[-1])) * np.where(out, 0, np.exp(np.clip(design @ x, -50, 50)))[:, None]
        if not np.isfinite(cell).all():
            return np.inf, target, np.eye(size)
        grad = design.T @ cell[:, 0] - target
        grad[-1] = cell[:, 1].sum() - target[-1]
        hess = (design * cell[:, :1]).T @ design
        hess[-1, :] = hess[:, -1] = design.T @ cell[:, 1]
        hess[-1, -1] = cell[:, 2].sum()
        return cell[:, 0].sum() - target @ x + RIDGE / 2 * x @ x, grad + RIDGE * x, hess + RIDGE * np.eye(size)

    value, grad, hess = dual(x)
    for _ in range(STEPS):
        if np.abs(grad).max() < PRECISION:
            break
        move, step = np.linalg.solve(hess, grad), 1.0
        while step > 1e-4:
            new = dual(x - step * move)
            if new[0] <= value - 1e-4 * step * (grad @ move) + 1e-12:
                break
            step /= 2
        else:
            break
        x = x - step * move
        value, grad, hess = new
    residual = float(np.abs(grad).max())
    if not residual <= TOLERANCE:
        warnings.warn(f"mixing: constraints are missed by up to {residual:.3g} of all tokens; they may contradict each other", stacklevel=2)
    shift = np.where(out, -np.inf, np.clip(design @ x, -50, 50))
    return Rates(cells, shift, float(x[-1]), mean, scale, dict(zip(sources, aim.tolist(), strict=True)), residual)


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", temper: float = TEMPER, all_rows: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``rate`` and ``copies``; without all_rows, only the documents with a copy at least.

    Rates are looked up by source and language in the pass that counts tokens; no text is shuffled.
    """
    names = docs.columns
    n_tokens, rate, copies = (free(names, n) for n in ("n_tokens", "rate", "copies"))
    row, shift = free([*names, n_tokens, rate, copies], "cell_key"), free([*names, n_tokens, rate, copies], "cell_rate")
    stats = text_columns(docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), "text", [("t", T.LongType())], token_counts, only=["source", "lang"])
    rates = solve(staged(stats, "tokens"), weights, temper)
    keyed = docs.withColumn(row, F.struct(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang")))
    counted = looked_up(keyed, text, row, n_tokens, shift, {c: float(np.exp(x)) for c, x in zip(rates.cells, rates.shift, strict=True)})
    r = F.col(shift) * F.exp(rates.column(F.col(n_tokens)))
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text)), F.lit(1 << 40)) / float(1 << 40)
    out = counted.withColumn(rate, r).withColumn(copies, F.floor(F.col(rate) + share).cast("long")).select(*names, n_tokens, rate, copies)
    return out if all_rows else out.filter(F.col(copies) > 0)


def looked_up(docs: DataFrame, text: str, row: str, n_tokens: str, shift: str, cells: dict[tuple, float]) -> DataFrame:
    """docs without ``row``, with numbers of tokens and each cell's factor (1 for a cell that isn't known)."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != row] + [T.StructField(n_tokens, T.LongType()), T.StructField(shift, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (tokens,) = batch_kernel(batch, text, token_counts, [pa.int64()])
            cell = batch.column(row)
            factor = [cells.get(c, 1.0) for c in zip(cell.field(0).to_pylist(), cell.field(1).to_pylist(), strict=True)]
            columns = [batch.column(f.name) for f in list(arrow)[:-2]] + [tokens.combine_chunks(), pa.array(factor, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)
