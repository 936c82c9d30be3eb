"""Words of UTF-8 bytes, found and hashed with whole-array operations.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D. Its hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums and mixed, so it
depends on the word alone and not on its place.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE) + 1, base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit, from a uint64 array to a new one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word."""
    space = np.ones(len(raw) + 2, np.bool_)
    space[1:-1] = is_space(raw)
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word; long input is taken in slices of whole words, so memory follows SLICE or the longest word."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = max(int(np.searchsorted(ends, at + SLICE, "right")), first + 1)
        part = raw[at : int(ends[last - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part))[: len(part)], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[b] - sums[a]) * powers(INVERSE, len(part))[a] + (b - a).astype(np.uint64))
        first = last
    return out


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` successive elements."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out)
