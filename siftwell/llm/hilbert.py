"""Hilbert curve index of integer points, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of integer points (rows) with coordinates below 2^bits; bits times dimensions may be
    at most 63.

    The transposed form of the index is made in place, one bit level of all points at a time
    (inverse undo, then Gray encoding), and its bits are interleaved at the end.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    level = np.uint64(1) << np.uint64(bits - 1)
    while level > one:
        below = level - one
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, np.uint64(0)) ^ swap
            x[i] ^= swap
        level >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = np.uint64(1) << np.uint64(bits - 1)
    while level > one:
        turn ^= np.where((x[n - 1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << one) | ((x[i] >> np.uint64(b)) & one)
    return index.astype(np.int64)
