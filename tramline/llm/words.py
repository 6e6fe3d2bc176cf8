"""Vectorised splitting and hashing of words over whole batches of UTF-8 text.

A word is a maximal run of bytes outside space and 0x09-0x0D; bytes of multi-byte characters are never among those.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 (a bijection)."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of every word, and for each row the number of words before it (n + 1 numbers)."""
    inside = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of_rows = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of_rows] = inside[ends_of_rows]
    ends = np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every word, over 8 bytes at a time; the length takes part."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(lens.astype(np.uint64) ^ np.uint64(seed))
    live = np.arange(len(starts))
    at, left = starts, lens
    while len(live):
        lane = lanes[at] & _KEEP[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ lane)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces; the order matters."""
    return mix(a * _M1 + b)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive hashes, by doubling (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            piece = power[done : done + len(h) - n + 1]
            out = piece if out is None else joined(out, piece)
            done += size
        if done == n:
            return out if n > 1 else out.copy()
        power = joined(power[:-size], power[size:])
        size *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of all runs of n consecutive values."""
    if len(x) < n:
        return x[:0]
    m, size = x, 1
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - size : n - size + len(x) - n + 1])


def whole_rows(before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs of n words that lie within one row, and the row of each."""
    counts = np.maximum(np.diff(before) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    return np.arange(len(row)) - skipped[row] + before[:-1][row], row
