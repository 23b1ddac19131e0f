"""Sparse logistic regression on the driver, over a bounded sample of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Entries that a step looks at together.
PART = 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Sparse rows: row i has the features idx[ptr[i]:ptr[i + 1]] with these values."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows that have about ``PART`` entries in all, one at least."""
        lo, n = 0, len(self.ptr) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + PART, side="right")) - 1)
            yield lo, hi
            lo = hi

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ptr) - 1)
        for lo, hi in self.parts():
            a, z = self.ptr[lo], self.ptr[hi]
            sums = np.zeros(z - a + 1)
            np.cumsum(w[self.idx[a:z]] * self.val[a:z], out=sums[1:])
            out[lo:hi] = sums[self.ptr[lo + 1 : hi + 1] - a] - sums[self.ptr[lo:hi] - a]
        return out

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        """For each feature the sum over rows of value times r."""
        out = np.zeros(size)
        for lo, hi in self.parts():
            a, z = self.ptr[lo], self.ptr[hi]
            out += np.bincount(self.idx[a:z], weights=self.val[a:z] * np.repeat(r[lo:hi], np.diff(self.ptr[lo : hi + 1])), minlength=size)
        return out

    def some(self, rows: np.ndarray) -> Rows:
        """Some rows, in their order here."""
        wanted = np.zeros(len(self.ptr) - 1, bool)
        wanted[rows] = True
        sizes = np.diff(self.ptr)
        entries = np.repeat(wanted, sizes)
        return Rows(np.concatenate([[0], np.cumsum(sizes[wanted])]), self.idx[entries], self.val[entries])


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 80, rate: float = 0.5, l1: float = 0.0, l2: float = 1e-6, least_rows: int = 2) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam steps over all rows; y may be soft. l1 is applied as a proximal step, so that noise gets a weight of nought."""
    w, b = np.zeros(size), 0.0
    if not len(y) or not weight.sum():
        return w, b
    often = np.bincount(x.idx, minlength=size) >= least_rows
    if not often.any():
        return w, float(np.log((np.dot(weight, y) + 1e-3) / (np.dot(weight, 1 - y) + 1e-3)))
    held, k = often[x.idx], int(often.sum())
    ptr = np.concatenate([[0], np.cumsum(held)])[x.ptr]
    x = Rows(ptr, (np.cumsum(often) - 1).astype(np.int32)[x.idx[held]], x.val[held])
    del held
    v, m, s, mb, sb = np.zeros(k), np.zeros(k), np.zeros(k), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        r = weight * (sigmoid(x.times(v) + b) - y)
        g = x.back(r, k) + l2 * v
        m, s = 0.9 * m + 0.1 * g, 0.98 * s + 0.02 * g * g
        step = rate * np.sqrt(1 - 0.98**t) / (1 - 0.9**t) / (np.sqrt(s) + 1e-10)
        v = v - step * m
        if l1:
            v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        mb, sb = 0.9 * mb + 0.1 * r.sum(), 0.98 * sb + 0.02 * r.sum() ** 2
        b -= rate * np.sqrt(1 - 0.98**t) / (1 - 0.9**t) * mb / (np.sqrt(sb) + 1e-10) * 0.3
    w[often] = v
    return w, float(b)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of the calibrated probability sigmoid(a * score + b), by Newton steps on smoothed labels."""
    up, down = float((y > 0.5).sum()), float((y <= 0.5).sum())
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([np.dot(r, score) + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[np.dot(h, score * score) + 1e-3, np.dot(h, score)], [np.dot(h, score), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
        if abs(move).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
