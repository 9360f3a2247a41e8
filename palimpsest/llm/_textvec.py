"""Words of many texts at once as numpy arrays: places, hashes and rows, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and all bytes above ASCII, 2 other signs
CLASS = np.full(256, 2, np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, p in enumerate((_P, _PINV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, nulls as empty, and the n+1 offsets."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    raw, off = buffers(texts)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(raw: np.ndarray, off: np.ndarray, cls: np.ndarray = CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of bytes of one class other than 0."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = cls[raw]
    brk = np.zeros(n + 1, bool)
    brk[1:n] = c[1:] != c[:-1]
    brk[off] = True
    s = np.flatnonzero(brk[:n])
    e = np.append(s[1:], n)
    keep = c[s] != 0
    s, e = s[keep], e[keep]
    return s, e, np.searchsorted(off, s, "right") - 1


def hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[s:e] for each s, e, by prefix sums of a polynomial."""
    p, inv = _pow(len(raw) + 1)
    pre = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=pre[1:])
    return mix((pre[e] - pre[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
