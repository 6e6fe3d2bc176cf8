"""Order statistics of a growing multiset as small nodes, so that a keyed state store changes only what a value touches.

A value's 64 bits, turned so that they sort as the number does, are its path: a node of depth d stands for all values that share
their first d bytes.  An inner node counts its 256 children; a leaf keeps its distinct values, sorted, with their
numbers, and becomes an inner node above LEAF of them.  Adding a value or finding a rank reads at most nine nodes,
however many values there are.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np

LEAF = 128
#: A node in the state store: counts of children (inner) or values and their numbers (leaf).
NODE = "counts array<long>, values array<double>, times array<long>"


def _path(v: float) -> bytes:
    bits = struct.unpack(">Q", struct.pack(">d", v + 0.0))[0]
    return struct.pack(">Q", bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63)


class ValueTree:
    """``read`` gives a stored node by its id (hex of the shared bytes) or None; ``changed`` has the nodes to write back."""

    def __init__(self, read: Callable[[str], tuple | None]):
        self._read = read
        self._nodes: dict[str, list] = {}
        self.changed: set[str] = set()

    def _node(self, name: str) -> list:
        if name not in self._nodes:
            stored = self._read(name)
            self._nodes[name] = [list(c or []) for c in stored] if stored else [[], [], []]
        return self._nodes[name]

    def node(self, name: str) -> tuple:
        return tuple(self._nodes[name])

    def add(self, v: float, n: int = 1) -> None:
        path, depth = _path(v), 0
        while True:
            name = path[:depth].hex()
            counts, values, times = self._node(name)
            self.changed.add(name)
            if counts:
                counts[path[depth]] += n
                depth += 1
                continue
            at = bisect_left(values, v)
            if at < len(values) and values[at] == v:
                times[at] += n
            else:
                values.insert(at, v)
                times.insert(at, n)
                if len(values) > LEAF:
                    self._split(name, depth)
            return

    def _split(self, name: str, depth: int) -> None:
        _, values, times = self._nodes[name]
        counts = [0] * 256
        for v, n in zip(values, times, strict=True):
            byte = _path(v)[depth]
            child = self._nodes.setdefault(name + f"{byte:02x}", [[], [], []])
            child[1].append(v)
            child[2].append(n)
            counts[byte] += n
            self.changed.add(name + f"{byte:02x}")
        self._nodes[name] = [counts, [], []]
        for byte in range(256):
            child = name + f"{byte:02x}"
            if counts[byte] and len(self._nodes[child][1]) > LEAF:
                self._split(child, depth + 1)

    def stored(self, name: str = "") -> Iterator[tuple[float, int]]:
        """All distinct values, ascending, with their numbers; reads every node."""
        counts, values, times = self._node(name)
        for byte in [b for b, n in enumerate(counts) if n]:
            yield from self.stored(name + f"{byte:02x}")
        yield from zip(values, times, strict=True)

    def select(self, k: int) -> float:
        """The k-th smallest, from 0."""
        name = ""
        while True:
            counts, values, times = self._node(name)
            if not counts:
                for v, n in zip(values, times, strict=True):
                    if k < n:
                        return v
                    k -= n
                raise IndexError("rank beyond the values")
            for byte, n in enumerate(counts):
                if k < n:
                    name += f"{byte:02x}"
                    break
                k -= n
            else:
                raise IndexError("rank beyond the values")

    def quantile(self, q: float, n: int) -> float | None:
        """Interpolated quantile of all n values."""
        if not n:
            return None
        at = q * (n - 1)
        low = int(at)
        a = self.select(low)
        return a if at == low else a + (self.select(min(low + 1, n - 1)) - a) * (at - low)


class Growing:
    """Order statistics of a stored multiset and the first p of the values that are added to it, for many p at once.

    A wavelet matrix: distinct values are numbered in order; level by level, ranks follow the bits of these numbers, counting
    stored and added values whose next bit is zero.
    """

    def __init__(self, values: np.ndarray, times: np.ndarray, added: np.ndarray):
        self.distinct, codes = np.unique(np.concatenate([values, added]), return_inverse=True)
        self.bits = max(1, (len(self.distinct) - 1).bit_length())
        stored = np.zeros(1 << self.bits, np.int64)
        stored[codes[: len(values)]] = times
        self.stored = np.concatenate([[0], np.cumsum(stored)])
        self.zeros, codes = [], codes[len(values) :]
        for b in reversed(range(self.bits)):
            one = (codes >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            codes = np.concatenate([codes[~one], codes[one]])

    def select(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the stored values and the first p added ones."""
        low, high, k, code = np.zeros_like(p), p, k.copy(), np.zeros_like(p)
        for b, z in zip(reversed(range(self.bits)), self.zeros, strict=True):
            zl, zh = z[low], z[high]
            less = zh - zl + self.stored[code + (1 << b)] - self.stored[code]
            one = k >= less
            k -= np.where(one, less, 0)
            code += np.where(one, 1 << b, 0)
            low, high = np.where(one, z[-1] + low - zl, zl), np.where(one, z[-1] + high - zh, zh)
        return self.distinct[code]

    def quantile(self, q: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Interpolated quantiles of all n values (stored ones and the first p)."""
        at = q * (n - 1)
        low = at.astype(np.int64)
        a, b = self.select(p, low), self.select(p, np.minimum(low + 1, n - 1))
        return np.where(at == low, a, a + (b - a) * (at - low))
