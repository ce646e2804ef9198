"""Words of many texts at once, found and hashed as arrays of bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: an odd multiplier for the polynomial hash (2^64 divided by the golden ratio).
BASE = 0x9E3779B97F4A7C15
GROUP = 100_000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a byte is of a word (digits, letters, all beyond ASCII), its lower case, and a random number for it."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    inside = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    noise = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return inside, lower, noise[lower]


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse modulo 2^64 to the powers 0..size-1."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; texts never share a word."""
    inside = tables()[0][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    starts = inside & ~(before[:-1] & ~edge[:-1])
    after = np.concatenate([inside, [False]])[1:]
    ends = inside & ~(after & ~edge[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each lower-cased word.

    A polynomial over a random number per byte, times the word's inverse first power;
    worked out for some words at a time, as it takes 8 bytes and more for each byte.
    """
    hashes = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), GROUP):
        first, end = starts[k : k + GROUP], ends[k : k + GROUP]
        part = data[first[0] : end[-1]]
        up, down = powers(1 << max(20, len(part).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(tables()[2][part] * up[: len(part)], out=total[1:])
        base = first[0]
        hashes[k : k + GROUP] = (total[end - base] - total[first - base]) * down[first - base]
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(BASE)
