"""Vectorised text kernels over the bytes of an Arrow string column.

A chunk is ``(data, off)``: the UTF-8 bytes of some whole documents, and where each begins and ends.
Words are runs of letters and digits in lower case; every byte above ASCII counts as a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes so that their low and high bits are usable alone."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, data, off)``: whole documents of about ``limit`` bytes in all, one at least."""
    data, off = text_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin letters."""
    out = LOWER[data]
    if data.size > 1:
        after = out[1:]
        k = np.flatnonzero((data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
        out[k + 1] += 0x20
    return out


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of every word."""
    n = data.size
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = WORD[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    first, final = off[:-1][full], off[1:][full] - 1
    begin[first], last[final] = inside[first], inside[final]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(data.size + 1)
    sums = np.zeros(data.size + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings between s and e, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word."""
    data = lower(data)
    s, e, doc = spans(data, off)
    return span_hash(prefix_sums(data), s, e), doc


def word_grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of n words."""
    if n == 1:
        return h, doc
    if len(h) < n:
        return h[:0], doc[:0]
    end = len(h) - n + 1
    g = h[:end].copy()
    for k in range(1, n):
        g = g * U64(BASE) + h[k : end + k]
    same = doc[:end] == doc[n - 1 :]
    return mix(g[same]), doc[:end][same]


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n <= 8 bytes from each place, without regard to documents; n - 1 fewer than bytes."""
    end = data.size - n + 1
    if end <= 0:
        return np.zeros(0, U64)
    g = data[:end].astype(U64)
    for k in range(1, n):
        g |= data[k : end + k].astype(U64) << U64(8 * k)
    return mix(g)


def gram_ends(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, from where to where its grams of n bytes lie in ``byte_grams``."""
    lo = off[:-1]
    return lo, np.maximum(lo, off[1:] - n + 1)


def range_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi]."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    lo, hi = np.minimum(lo, len(values)), np.minimum(hi, len(values))
    return sums[np.maximum(hi, lo)] - sums[lo]
