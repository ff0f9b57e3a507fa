"""Counting quotient filters: lossless compact counters of whole numbers, kept sorted, cut by range and merged.

A number of `bits` bits goes through an invertible permutation, which spreads the numbers evenly. The upper bits of the
result are its quotient and are not stored: a filter notes how many numbers each quotient has (one bit per number and one
per quotient) and their full remainders, so the number can be had back. A count takes one byte; greater counts follow
apart, whole. Entries lie in the order of the permuted numbers, so filters merge like sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

from catalens.llm.common import ship_with_tasks

ship_with_tasks(__name__)

_ODD = 0x9E3779B97F4A7C15
_HEAD = "<QBBQ"
#: Counts from here on are stored apart.
_MANY = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(x: np.ndarray, bits: int) -> np.ndarray:
    """An invertible mixing of whole numbers below 2^bits, 1 <= bits <= 64."""
    half, mask = np.uint64(max(1, bits // 2)), _mask(bits)
    x = x.astype(np.uint64)
    for odd in (_ODD, _ODD ^ 0xFFFFFFFF00):
        x = (x * np.uint64(odd)) & mask
        x ^= x >> half
    return x


def restore(x: np.ndarray, bits: int) -> np.ndarray:
    """The numbers that `permute` turned into these."""
    half, mask = max(1, bits // 2), _mask(bits)
    for odd in (_ODD ^ 0xFFFFFFFF00, _ODD):
        # A shift by about half the bits is undone by applying it until nothing is left to shift in.
        y, shift = x.copy(), half
        while shift < bits:
            y ^= x >> np.uint64(shift)
            shift += half
        x = (y * np.uint64(pow(odd, -1, 1 << 64))) & mask
    return x


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, without gaps."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, 64 - width:].ravel()).tobytes()


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, 64 - width:] = bits
    return np.packbits(whole, axis=1).view(">u8").ravel().astype(np.uint64)


def build(permuted: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct permuted numbers below 2^bits and their counts."""
    n = len(permuted)
    upper = min(bits, max(0, int(n).bit_length() - 1))
    lower = bits - upper
    quotient = (permuted >> np.uint64(lower)).astype(np.int64) if lower < 64 else np.zeros(n, np.int64)
    ends = np.zeros(n + (1 << upper), np.uint8)
    ends[np.arange(n) + quotient] = 1
    many = counts[counts >= _MANY].astype("<u8")
    return b"".join((
        struct.pack(_HEAD, n, bits, upper, len(many)), np.packbits(ends).tobytes(), _pack(permuted & _mask(lower), lower),
        np.minimum(counts, _MANY).astype(np.uint8).tobytes(), many.tobytes()))


def entries(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted permuted numbers of a filter and their counts."""
    n, bits, upper, n_many = struct.unpack_from(_HEAD, filter_)
    lower, at = bits - upper, struct.calcsize(_HEAD)
    size = -(-(n + (1 << upper)) // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(filter_, np.uint8, size, at), count=n + (1 << upper)))
    at += size
    size = -(-(n * lower) // 8)
    remainder = _unpack(filter_[at:at + size], lower, n)
    at += size
    counts = np.frombuffer(filter_, np.uint8, n, at).astype(np.int64)
    counts[counts == _MANY] = np.frombuffer(filter_, "<u8", n_many, at + n).astype(np.int64)
    quotient = (ones - np.arange(n)).astype(np.uint64)
    return (quotient << np.uint64(lower) if lower < 64 else quotient) | remainder, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted permuted numbers of all filters together, and the sums of their counts."""
    parts = [entries(f) for f in filters]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")  # sorted stretches are merged
    keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts
