"""Hashed word n-grams of whole texts, and linear models over them.

A text's words are its runs of letters and digits and its runs of other signs. Features are the
words (A-Z lower-cased), pairs of neighbours, and the same two for the words' shapes: kind, case
and whether a word repeats the one before. Each occurrence of n has the value 1/sqrt(n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from palimpsest.llm._textvec import CLASS, LOWER, hashes, mix, runs, words

_UP = np.zeros(256, bool)
_UP[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(texts: pa.Array, bits: int, shapes: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each occurrence from 0, its slot) for runs of rows."""
    shift = np.uint64(64 - bits)
    for lo, hi, raw, off in runs(texts):
        low = LOWER[raw]
        s, e, row = words(raw, off, CLASS)
        h = hashes(low, s, e)
        same_row = row[1:] == row[:-1]
        out_row, out = [row, row[1:][same_row]], [h, mix(h[:-1] * np.uint64(3) + h[1:])[same_row]]
        if shapes:
            up = _UP[raw]
            count = np.append(0, np.cumsum(up))
            ups = count[e] - count[s]
            case = np.where(ups == 0, 0, np.where((ups == 1) & up[s], 1, 2)) if len(s) else np.zeros(0, np.int64)
            again = np.append(False, same_row & (h[1:] == h[:-1])) if len(s) else np.zeros(0, bool)
            kind = CLASS[raw[s]] if len(s) else np.zeros(0, np.uint8)
            k = (kind * 3 + case) * 2 + again + 1000 * (_DIGIT[raw[s]] if len(s) else 0)
            g = mix(k.astype(np.uint64) + np.uint64(0x5AFE))
            out_row += [row, row[1:][same_row]]
            out += [g, mix(g[:-1] * np.uint64(5) + g[1:])[same_row]]
        yield lo, hi, np.concatenate(out_row), (np.concatenate(out) >> shift).astype(np.int64)


def scores(texts: pa.Array, weights: np.ndarray, bias: np.ndarray, bits: int) -> np.ndarray:
    """Sparse dot products: one row per text, one column per column of weights."""
    out = np.zeros((len(texts), weights.shape[1]))
    for lo, hi, row, slot in features(texts, bits):
        n = np.bincount(row, minlength=hi - lo)
        for k in range(weights.shape[1]):
            out[lo:hi, k] = np.bincount(row, weights[slot, k], hi - lo) / np.sqrt(np.maximum(n, 1)) + bias[k]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader with one learning rate per coordinate, logistic loss."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 0.05, l1: float = 0.3, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(texts: pa.Array, labels: np.ndarray, bits: int, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of 2**bits slots and the bias for each column of labels of 0 and 1, -1 for none; texts in
    the order given, each epoch in another order. The features are made once for all columns."""
    size = 1 << bits
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi, row, slot in features(texts, bits):
        key, times = np.unique(row * size + slot, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) * size)
        for k in range(hi - lo):
            c = times[cut[k] : cut[k + 1]]
            made.append(((key[cut[k] : cut[k + 1]] % size).astype(np.int32), c.astype(np.int32)))  # eight bytes a feature
    out = []
    for y in labels.T:
        model, order, known = Ftrl(size + 1), np.random.default_rng(seed), np.flatnonzero(y >= 0)
        for _ in range(epochs):
            for k in known[order.permutation(len(known))]:
                slot, c = made[k]
                model.learn(np.append(slot, size), np.append(c / np.sqrt(max(c.sum(), 1)), 1.0), y[k])
        out.append(model.weights())
    w = np.stack(out, 1)
    return w[:-1], w[-1]
