"""NumPy kernels of the shared-span operator: Rabin-Karp hashes of fixed-length character windows.

A window is owned by the smallest of the anchor hashes inside it (the leftmost of equal ones), so equal windows
have equal owners wherever they stand. Consecutive windows with one owner make a *run*.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# Two odd bases for polynomial hashes modulo 2^64; code points are mixed first, so text structure doesn't align with them.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of a base and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(0, U64)

    def reach(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(self.n, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = tuple(Powers(b) for b in BASES)


class Rolling:
    """Prefix hashes of one text; ``window(i, n)`` hashes the n characters from each position i."""

    def __init__(self, text: str, which: int = 0) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.powers = len(codes), _POWERS[which]
        self.powers.reach(self.n + 1)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(codes.astype(U64) + U64(0x632BE59BD9B4E019)) * self.powers.up[: self.n], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """Hashes of every window of the width."""
        m = self.n - width + 1
        return mix((self.sums[width : width + m] - self.sums[:m]) * self.powers.down[:m]) if m > 0 else np.zeros(0, U64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers.down[start] + (end - start).astype(U64))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of every w consecutive values, from minima inside blocks of w."""
    m = len(x) - w + 1
    blocks = -(-len(x) // w)
    grid = np.full((blocks, w), np.iinfo(U64).max, U64)
    grid.ravel()[: len(x)] = x
    at = np.arange(blocks * w, dtype=np.int64).reshape(blocks, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    ahead_at = np.minimum.accumulate(np.where(grid == ahead, at, blocks * w)[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    behind = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones((blocks, w), bool)
    fresh[:, 1:] = behind[:, 1:] < behind[:, :-1]
    behind_at = np.maximum.accumulate(np.where(fresh, at, -1), axis=1).ravel()[w - 1 : w - 1 + m]
    return np.where(ahead.ravel()[:m] <= behind.ravel()[w - 1 : w - 1 + m], ahead_at, behind_at)


def runs(text: str, length: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """For each run of windows with one owner: hash of the anchor, hash of all its text, first window, windows."""
    roll = Rolling(text)
    if roll.n < length:
        return None
    own = sliding_argmin(grams := roll.all(anchor), length - anchor + 1)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    count = np.diff(np.r_[first, len(own)])
    at = own[first]
    context = Rolling(text, 1).spans(first, first + count - 1 + length)
    context ^= mix((at - first).astype(U64) << U64(32) | count.astype(U64))
    return grams[at], context, first, count


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the given ones; those that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[first], end[np.r_[first[1:] - 1, len(end) - 1]]
