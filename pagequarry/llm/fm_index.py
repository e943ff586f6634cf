"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet tree."""

from __future__ import annotations

import numpy as np

#: The bits before each place of a word.
_BEFORE = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class BitVector:
    """Bits in 64-bit words with counts before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        w = i >> 6
        found = self.words.take(w)
        found &= _BEFORE.take(i & 63)
        return self.before.take(w) + np.bitwise_count(found)


class WaveletTree:
    """A sequence of small numbers, level by level from the highest bit, zeros before ones on each level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.bits, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            self.bits.append(BitVector(bit))
            self.zeros.append(self.n - self.bits[-1].ones)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where positions i (in the last dimension, one for each symbol) are on the last level, seen as before symbols like the given ones."""
        i = i.astype(np.int32)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank(i)
            i = np.where((symbol >> level) & 1 == 1, np.int32(self.zeros[k]) + ones, i - ones)
        return i


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The order of the cyclic rotations, by prefix doubling; by their first ``depth`` numbers at least, if that is given.

    Rotations alike that far are in the order of the text.
    """
    n = len(text)
    rank = text.astype(np.int64)
    width, most = 1, n if depth is None else min(n, depth)
    while width < most:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == n:
            break
        width *= 2
    return np.argsort(rank, kind="stable")


class FmIndex:
    """Backward search over a text of numbers from 1 on, in which 0 separates pieces.

    With ``depth`` the rotations are sorted no further than patterns of that length need: the rows
    that begin with a pattern are then still next to each other, and a step backwards only counts
    the rows before them, whatever their order among themselves.
    """

    def __init__(self, text: np.ndarray, depth: int | None = None):
        self.order, self.depth = suffix_array(text, depth), depth
        size = int(text.max()) + 1 if len(text) else 1
        self.tree = WaveletTree(text[self.order - 1], max(1, int(size - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        symbols = np.arange(size)
        self.start = self.tree.place(symbols, np.zeros(size, np.int64))

    def intervals(self, patterns: np.ndarray, until_alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the sorted rotations that begin with each pattern (a row of numbers).

        With ``until_alone`` the search of a pattern that is known to occur ends as soon as its
        interval has one row: it then occurs once, and the interval is that of a suffix of it.
        """
        m, length = patterns.shape
        if self.depth is not None and length > self.depth:
            raise ValueError("patterns longer than the depth of the index")
        last = patterns[:, -1]
        both = np.stack([self.first[last], self.first[last + 1]])
        live = np.arange(m)
        for k in range(length - 2, -1, -1):
            if until_alone:
                live = live[both[1, live] - both[0, live] > 1]
                if not len(live):
                    break
            c = patterns[live, k]
            both[:, live] = self.first[c] - self.start[c] + self.tree.place(c, both[:, live])
        return both[0], both[1]
