"""An n-gram trie of Elias-Fano levels.

A level is the children of all nodes of the level above, node by node, each node's children in order. Adding the last value of
the range before makes that sequence monotone, and so are the pointers to where ranges begin; both are stored in
Elias-Fano form: low bits packed, high bits in unary. A child is looked up relative to its context: the target is the range's base plus
the child, its bucket of equal high bits is found by two selects, and a short search in it ends at the successor.

All searches take arrays, so a query is a step for many n-grams at once. A trie is written to one file and mapped into memory.
"""

from __future__ import annotations

import json
from typing import BinaryIO

import numpy as np

WORD = 64


def _bits_of(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits from each bit position on."""
    if not width:
        return np.zeros(len(at), np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    # Shifted twice, since a shift by 64 isn't defined.
    high = words[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
    return (low | high) & np.uint64((1 << width) - 1)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the bit with this rank among the set bits of each word."""
    place, words = np.zeros(len(words), np.int64), words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = rank >= ones
        rank = rank - ones * beyond
        place += width * beyond
        words >>= (width * beyond).astype(np.uint64)
    return place


class EliasFano:
    """A monotone sequence of whole numbers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        # Zeros before each word of the high bits.
        self.zeros = np.arange(len(ones), dtype=np.int64) * WORD - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        low = np.zeros(n * width // WORD + 2, np.uint64)
        if width and n:
            own, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, own << shift)
            np.bitwise_or.at(low, word + 1, own >> (np.uint64(63) - shift) >> np.uint64(1))
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) if n else 0) // WORD + 2
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))[:-1]
        return cls(n, width, low, high, ones)

    def _select1(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank, "right") - 1
        return word * WORD + _select_in_word(self.high[word], rank - self.ones[word])

    def _select0(self, rank: np.ndarray) -> np.ndarray:
        """Where the zero with this rank is; behind the end if there is none."""
        word = np.searchsorted(self.zeros, rank, "right") - 1
        return word * WORD + _select_in_word(~self.high[word], rank - self.zeros[word])

    def _low(self, at: np.ndarray) -> np.ndarray:
        return _bits_of(self.low, at * self.width, self.width)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        high = (self._select1(at) - at).astype(np.uint64)
        return (high << np.uint64(self.width) | self._low(at)).astype(np.int64)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is not less than each of these, or ``n``."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), self.n, np.int64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        most = len(self.high) * WORD - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1]))
        beyond = high >= most
        high = np.where(beyond, 0, high)
        # The bucket: elements between the zeros before and behind this high part.
        first = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - high + 1, 0)
        last = np.minimum(self._select0(high) - high, self.n)
        asked = values & np.uint64((1 << self.width) - 1)
        low, up = first, last
        for _ in range(int(np.max(last - first, initial=0)).bit_length()):
            middle = (low + up) >> 1
            less = (low < up) & (self._low(np.minimum(middle, self.n - 1)) < asked)
            low, up = np.where(less, middle + 1, low), np.where(less, up, np.minimum(middle, up))
        return np.where(beyond, self.n, low)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]


class Trie:
    """Levels of (children, pointers, codes). ``codes`` are numbers that each node of a level carries."""

    def __init__(self, levels: list[tuple[EliasFano, EliasFano, list[np.ndarray]]]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, keys: list[np.ndarray], parents: list[np.ndarray], codes: list[list[np.ndarray]]) -> Trie:
        """``keys``: the children of each level in order; ``parents``: the place of each one's parent in the level above (zeros in the first)."""
        levels, above = [], 1
        for key, parent, own in zip(keys, parents, codes, strict=True):
            starts = np.searchsorted(parent, np.arange(above + 1))
            key = key + 1  # so that values never repeat
            # The last child of each range is added to all behind it.
            lasts = np.where(starts[1:] > starts[:-1], key[np.maximum(starts[1:] - 1, 0)], 0) if len(key) else np.zeros(above, np.int64)
            base = np.cumsum(lasts) - lasts
            levels.append((EliasFano.of(key + base[parent]), EliasFano.of(starts), own))
            above = len(key)
        return cls(levels)

    def find(self, level: int, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The places of children in a level, -1 where there is none. ``parent``: places in the level above, or -1."""
        children, pointers, _ = self.levels[level]
        out = np.full(len(key), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        if not len(some) or not children.n:
            return out
        own = parent[some]
        start, end = pointers[own], pointers[own + 1]
        base = np.where(start > 0, children[np.maximum(start - 1, 0)], 0)
        target = base + key[some] + 1
        at = children.successor(target)
        inside = (start <= at) & (at < end)
        hit = np.flatnonzero(inside)
        hit = hit[children[at[hit]] == target[hit]]
        out[some[hit]] = at[hit]
        return out

    def save(self, file: BinaryIO) -> None:
        arrays, layout = [], []
        for children, pointers, codes in self.levels:
            layout.append([[children.n, children.width], [pointers.n, pointers.width], len(codes)])
            arrays += [*children.arrays(), *pointers.arrays(), *codes]
        head = json.dumps([layout, [[a.dtype.str, len(a)] for a in arrays]]).encode()
        head += b" " * (-len(head) % 8)
        file.write(len(head).to_bytes(8, "little") + head)
        for array in arrays:
            file.write(array.tobytes() + bytes(-array.nbytes % 8))
        file.flush()

    @classmethod
    def mapped(cls, file: BinaryIO) -> Trie:
        """A saved trie, read where it is."""
        whole = np.memmap(file, np.uint8, "r")
        size = int.from_bytes(whole[:8].tobytes(), "little")
        layout, kinds = json.loads(whole[8 : 8 + size].tobytes())
        at, arrays = 8 + size, []
        for kind, length in kinds:
            nbytes = np.dtype(kind).itemsize * length
            arrays.append(whole[at : at + nbytes].view(kind))
            at += nbytes + -nbytes % 8
        levels, k = [], 0
        for children, pointers, codes in layout:
            levels.append((EliasFano(*children, *arrays[k : k + 3]), EliasFano(*pointers, *arrays[k + 3 : k + 6]), arrays[k + 6 : k + 6 + codes]))
            k += 6 + codes
        return cls(levels)
