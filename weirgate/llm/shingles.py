"""Word shingles of whole texts as 64-bit hashes, in steps over many texts at once."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hashes.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of texts that lie one after the other, and each text's number of words.

    A-Z count as a-z; words are what U+0009 to U+000D and the space separate.
    """
    letter = ~_BLANK[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_texts] = letter[starts_of_texts]
    starts = np.flatnonzero(first)
    # A word ends before the next blank, or where its text does.
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[starts_of_texts[1:] - 1] = letter[starts_of_texts[1:] - 1]
    ends = np.flatnonzero(last) + 1
    up = powers(BYTE_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=sums[1:])
    down = powers(_INVERSE, len(data))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * WORD_BASE) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's set of hashed shingles, sorted; a shorter text's whole sequence is its one shingle."""
    hashes, counts = word_hashes(data, offsets)
    factors = powers(WORD_BASE, width)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        rolled += hashes[i : len(hashes) - width + 1 + i] * factors[i]
    rolled = mix(rolled)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= width:
            own = np.sort(rolled[at : at + n - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = mix((hashes[at : at + n] * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        at += n
    return sets
