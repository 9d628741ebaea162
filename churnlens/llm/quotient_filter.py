"""Counting quotient filters that lose nothing.

A key is an n-gram of one to three word numbers below ``2 ** bits``, packed into two halves of
``half_bits(bits)`` bits.  An invertible permutation (four Feistel rounds) spreads the keys
evenly, so their top bits deal them to shards of equal size.  Within a shard the next bits are the
*quotient*: it is not stored, but follows from an entry's place in a bit string with a one for each
entry and a zero for each quotient.  All other bits, the *remainder*, are stored whole, so the
key comes back exactly: counts are of keys, never of hashes.  Entries are sorted, so filters
merge like sorted runs.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ROUNDS = [(0x9E3779B97F4A7C15, 29), (0xC2B2AE3D27D4EB4F, 31), (0x165667B19E3779F9, 30), (0xD6E8FEB86659FD93, 32)]
_HEAD = 5       # numbers before the payload: entries, quotient bits, bytes of bits, of one remainder half, large counts


def half_bits(bits: int) -> int:
    return (3 * bits + 1) // 2


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _mixed(x: np.ndarray, k: int, half: int) -> np.ndarray:
    odd, shift = _ROUNDS[k]
    x = (x + _U(k + 1)) * _U(odd)
    return ((x ^ (x >> _U(shift))) * _U(odd)) >> _U(64 - half)


def pack(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of n-grams given as three columns of word numbers (0: no word)."""
    a, b, c = (words[:, k].astype(_U) for k in range(3))
    low = half_bits(bits) - bits        # bits of the middle word in the right half
    return (a << _U(bits - low)) | (b >> _U(low)), ((b & _mask(low)) << _U(bits)) | c


def unpack(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    low = half_bits(bits) - bits
    b = ((left & _mask(bits - low)) << _U(low)) | (right >> _U(bits))
    return np.stack([left >> _U(bits - low), b, right & _mask(bits)], axis=1).astype(np.int64)


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    half = half_bits(bits)
    for k in range(len(_ROUNDS)):
        left, right = right, left ^ _mixed(right, k, half)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    half = half_bits(bits)
    for k in reversed(range(len(_ROUNDS))):
        left, right = right ^ _mixed(left, k, half), left
    return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries, equal keys added up."""
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    if not len(left):
        return left, right, counts
    first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[first], right[first], np.add.reduceat(counts, first)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values_of(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width if width else 0, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(_U)


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: int, shard_bits: int) -> bytes:
    """A filter of sorted entries of one shard (their top ``shard_bits`` bits are equal)."""
    half, n = half_bits(bits), len(left)
    quotient_bits = min(max(n - 1, 0).bit_length(), half - shard_bits)
    rest = half - shard_bits - quotient_bits
    inner = left & _mask(half - shard_bits)
    quotient = (inner >> _U(rest)).astype(np.int64)
    occupied = np.zeros(n + (1 << quotient_bits), np.uint8)
    occupied[quotient + np.arange(n)] = 1
    large = counts >= 255
    widths = (rest + 7) // 8, (half + 7) // 8
    parts = [np.packbits(occupied).tobytes(), _bytes_of(inner & _mask(rest), widths[0]), _bytes_of(right, widths[1]),
             np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    return np.array([n, quotient_bits, len(parts[0]), widths[0], int(large.sum())], "<i8").tobytes() + b"".join(parts)


def decode(raw: bytes, bits: int, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a filter."""
    half = half_bits(bits)
    n, quotient_bits, size, width, large = np.frombuffer(raw, "<i8", _HEAD).tolist()
    rest, at = half - shard_bits - quotient_bits, 8 * _HEAD
    ends = np.cumsum([size, n * width, n * ((half + 7) // 8), n, 8 * large]) + at
    cut = [raw[s:e] for s, e in zip([at, *ends], ends)]
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(cut[0], np.uint8))[:n + (1 << quotient_bits)])
    quotient = (ones - np.arange(n)).astype(_U)
    low = _values_of(cut[1], width) if width else np.zeros(n, _U)
    left = (_U(shard) << _U(half - shard_bits)) | (quotient << _U(rest)) | low
    counts = np.frombuffer(cut[3], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(cut[4], "<i8")
    return left, _values_of(cut[2], (half + 7) // 8), counts


class Merger:
    """Filters of one shard merged as they come: what is held at a time is the shard's
    different keys and as many entries again."""

    def __init__(self, bits: int, shard_bits: int, shard: int):
        self.args = bits, shard_bits, shard
        self.held = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        self.new: list[tuple] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        entries = decode(raw, *self.args)
        self.new.append(entries)
        self.size += len(entries[0])
        if self.size > max(len(self.held[0]), 200_000):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.held = summed(*(np.concatenate([x[k] for x in (self.held, *self.new)]) for k in range(3)))
        self.new, self.size = [], 0
        return self.held
