"""Word hashes of texts, computed for many texts at once on their bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

M, A = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of M and of its inverse, modulo 2^64."""
    def of(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return of(M), of(pow(M, -1, 1 << 64))


@lru_cache(1)
def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased hash value of each byte, and whether it belongs to a word."""
    low = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    word = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
    return mix((low.astype(np.uint64) + np.uint64(1)) * np.uint64(A)), word


def words_of(buf: np.ndarray, off: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte and row of each word; words are runs of letters, digits and non-ASCII bytes, or of the bytes ``within``; A-Z folded."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    value, is_word = _bytes_table()
    w = (is_word if within is None else within)[buf]
    before = np.concatenate([[False], w[:-1]])
    after = np.concatenate([w[1:], [False]])
    full = off[:-1][np.diff(off) > 0]
    before[full] = False
    after[off[1:][np.diff(off) > 0] - 1] = False
    first, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    size = 1 << max(19, int(len(buf) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * up[: len(buf)], out=sums[1:])
    h = mix((sums[end] - sums[first]) * down[first])
    return h, first, end, np.searchsorted(off, first, "right") - 1
