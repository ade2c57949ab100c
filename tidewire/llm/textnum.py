"""Vectorised tokenising and hashing of text bytes in numpy."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 0 white space, 1 letters and digits (any byte of a non-ASCII character too), 2 all else
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    up, down = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words, and each row's range of words (n + 1)."""
    return runs(SPACE[data].astype(np.uint8) ^ 1, offsets)


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one nonzero kind that stay inside their row."""
    n = len(kinds)
    change = np.ones(n, bool)
    if n:
        np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
        inner = offsets[1:-1]
        change[inner[inner < n]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    keep = kinds[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` neighbouring hashes, in order; ``len - size + 1`` of them, rows not respected."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(out)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between neighbouring bounds, empty ranges giving 0."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
