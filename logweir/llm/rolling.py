"""Hashes of substrings of a byte string and locally chosen anchor positions, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(5)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Positions take the low bits of an ordering key, so a text is handled in stretches of less than 2 ** POS_BITS bytes.
POS_BITS = 24
_POS = np.uint64((1 << POS_BITS) - 1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Substring hashes of `data` from running sums: equal strings have equal hashes wherever they stand."""

    def __init__(self, data: bytes):
        codes = _TABLE[np.frombuffer(data, dtype=np.uint8)]
        self.n = len(codes)
        up, self.down = _grown(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(codes * up[: self.n], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Hash of the substring of `size` bytes at each position that has one."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[size:] - self.sums[:m]) * self.down[:m] + np.uint64(size))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive hashes the place of its smallest one, the leftmost on ties.

    Minima of blocks from either side make each window's minimum one comparison (a window spans two blocks)."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(h) > _POS:
        half = 1 << (POS_BITS - 1)
        return np.concatenate([leftmost_minima(h[a : a + half + width - 1], width) + a for a in range(0, m, half)])
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & _POS).astype(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the runs [start, end)."""
    keep = (starts < ends) & (starts < n) & (ends > 0)
    starts, ends = np.maximum(starts[keep], 0), np.minimum(ends[keep], n)
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def chained(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Identifiers of the sequences ids[i:j], from running sums: equal sequences have equal ones wherever they stand."""
    up, down = _grown(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(ids * up[: len(ids)], out=sums[1:])
    return mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))


def ints(x) -> np.ndarray:
    return np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64)


def packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs as single numbers that sort by start."""
    return (start.astype(np.int64) << 32) | end.astype(np.int64)


def unpacked(x) -> tuple[np.ndarray, np.ndarray]:
    x = ints(x)
    return x >> 32, x & 0xFFFFFFFF
