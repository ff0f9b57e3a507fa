"""Shingle sets and their SuperMinHash signatures, vectorised over blocks of documents.

Every element draws a random permutation of the SLOTS signature places and a random number for each rank: at its j-th
place it offers j plus the number, and a place keeps the least offer. Because an element's ranks are a permutation, its
offers to different places are negatively correlated, which lowers the variance of the estimate. Ranks are worked off
from the first on, all elements of a block at a time; a document stops early as soon as every place holds an offer of a
rank already passed, since later ranks can only offer more.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from catalens.llm.common import lower_words, ship_with_tasks

ship_with_tasks(__name__)

WORDS_IN_SHINGLE = 5
ROWS_IN_BAND, BANDS = 6, 60
SLOTS = ROWS_IN_BAND * BANDS
#: Elements worked on at once; their permutations take SLOTS * 2 bytes each.
ELEMENTS = 16_384
_NONE = np.int64(1 << 62)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter-based generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], seen: dict[bytes, int], width: int = WORDS_IN_SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` lower-cased words.

    A text of fewer words has its whole word sequence as the one shingle, a text without words or null an empty set.
    """
    words = [lower_words(t) for t in texts]
    if len(seen) > 150_000:
        seen.clear()
    for w in set().union(*words).difference(seen):
        seen[w] = xxh3_64_intdigest(w)
    out = []
    for ws in words:
        h = np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))
        n = max(len(h) - width + 1, min(len(h), 1))
        # The place of a word in its shingle goes into the sum, so that order counts.
        total = np.zeros(n, np.uint64)
        for i in range(min(width, len(h))):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n] + np.uint64(i + 1))
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signature (rank and number in one integer) of each set; empty sets keep the greatest value."""
    out = np.full((len(sets), SLOTS), _NONE, np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    edges, total = [0], 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= ELEMENTS:
            edges.append(i + 1)
            total = 0
    for a, b in zip(edges, [*edges[1:], len(sets)]):
        if b > a and sizes[a:b].any():
            _sign(np.concatenate(sets[a:b]), np.repeat(np.arange(b - a), sizes[a:b]), out[a:b])
    return out


def _sign(element: np.ndarray, row: np.ndarray, out: np.ndarray) -> None:
    flat, places, open_rows = out.reshape(-1), None, np.bincount(row, minlength=len(out)) > 0
    for rank in range(SLOTS):
        drawn = _mix(element + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((drawn >> np.uint64(32)) * np.uint64(SLOTS - rank) >> np.uint64(32)).astype(np.int64)
        if places is None:
            slot = pick
        else:
            at = np.arange(len(element))
            slot = places[at, pick].astype(np.int64)
            places[at, pick] = places[:, rank]
        np.minimum.at(flat, row * SLOTS + slot, (np.int64(rank) << np.int64(32)) | (drawn & np.uint64(0xFFFFFFFF)).astype(np.int64))
        open_rows &= out.max(axis=1) >= (np.int64(rank + 1) << np.int64(32))
        stay = open_rows[row]
        if not stay.any():
            return
        if places is None:
            element, row, pick = element[stay], row[stay], pick[stay]
            places = np.tile(np.arange(SLOTS, dtype=np.uint16), (len(element), 1))
            places[np.arange(len(element)), pick] = 0
        elif not stay.all():
            element, row, places = element[stay], row[stay], places[stay]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band; the band's number is part of it."""
    parts = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS_IN_BAND)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS_IN_BAND):
        key = _mix(key + parts[:, :, i])
    return key.view(np.int64)
