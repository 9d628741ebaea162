"""A minimal perfect hash over 128-bit keys, as numpy arrays.

Level by level, every key left over sets one bit of a bit array; a bit that just
one key set belongs to that key, the others go on to the next level.  A key's slot
is the rank of its bit over all levels, so n keys get the slots 0 to n-1.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = 0x9E3779B97F4A7C15


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    x = (hi + np.uint64(_STEP * (2 * level + 1) % 2 ** 64)) * _M1
    x ^= lo + np.uint64(_STEP * (2 * level + 2) % 2 ** 64) + (x >> np.uint64(29))
    x *= _M2
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots for distinct keys (hi, lo); ``slots`` of other keys are arbitrary or -1."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []   # bits as 64-bit words, rank before each word
        left, before = np.arange(len(hi)), 0
        while len(left):
            size = max(64, int(gamma * len(left)) + 63) // 64 * 64
            at = (_mix(hi[left], lo[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((words, ranks))
            before += int(alone.sum())
            left = left[~alone[at]]

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (words, ranks) in enumerate(self.levels):
            at = _mix(hi[left], lo[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out
