"""A compressed full-text index of word sequences: Burrows-Wheeler transform, wavelet tree, backward search.

The sequences are terminated one by one, the terminators ordered as the sequences. Bits of the wavelet tree are
packed 64 to a word beside one count each, so the tree takes about 1.5 bits a word and level. Of the suffix array only
every RATE-th position of a text is kept; the others are found by walking back through the transform. All operations
work on whole arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

from .common import U64
from .decontamination import suffix_array


RATE = 8  # positions of which one is kept


class BitVector:
    """Bits with rank: how many ones stand before each of many positions."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        inside = self.words[block] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return self.before[block].astype(np.int64) + np.bitwise_count(inside)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1


class WaveletTree:
    """Levels of a wavelet tree laid out level by level (a wavelet matrix), high bits first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[BitVector, int, int]] = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit) & 1
            self.levels.append((BitVector(bits), int(len(bits) - bits.sum()), bit))
            symbols = symbols[np.argsort(bits, kind="stable")] if len(symbols) < 2 else np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def count(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the symbols stand before lo and before hi."""
        start = np.zeros(len(symbol), np.int64)
        for vector, zeros, bit in self.levels:
            ones = np.concatenate([start, lo, hi])
            ones = vector.rank(ones)
            n = len(symbol)
            s1, l1, h1 = ones[:n], ones[n : 2 * n], ones[2 * n :]
            up = ((symbol >> bit) & 1) == 1
            start = np.where(up, zeros + s1, start - s1)
            lo = np.where(up, zeros + l1, lo - l1)
            hi = np.where(up, zeros + h1, hi - h1)
        return lo - start, hi - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each stands before its place."""
        start, symbol = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n = len(at)
        for vector, zeros, bit in self.levels:
            up = vector.get(at)
            ones = vector.rank(np.concatenate([start, at]))
            start = np.where(up, zeros + ones[:n], start - ones[:n])
            at = np.where(up, zeros + ones[n:], at - ones[n:])
            symbol |= up.astype(np.int64) << bit
        return symbol, at - start


class FmIndex:
    """Over sequences of symbols from 1; `offsets` are the sequences' bounds in `symbols`."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, sigma: int):
        n, k = len(symbols), len(offsets) - 1
        size = np.diff(offsets)
        order = suffix_array(symbols, np.repeat(offsets[1:], size))
        self.first_row = k  # rows before are the terminators'
        before = np.zeros(n, symbols.dtype)
        before[1:] = symbols[:-1]
        begins = offsets[:-1][size > 0]
        before[begins] = 0
        held = np.zeros(n, bool)  # a sequence's first position has no predecessor to walk to
        held[::RATE] = held[begins] = True
        held = held[order]
        self.kept, self.samples = BitVector(held), order[held].astype(np.int32)
        last = np.zeros(k, symbols.dtype)
        last[size > 0] = symbols[offsets[1:][size > 0] - 1]
        self.tree = WaveletTree(np.concatenate([last, before[order]]).astype(np.int64), sigma)
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.below = k + np.cumsum(counts) - counts

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes of these rows: steps back to a position that is kept, and that position."""
        out, walked = np.zeros(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows - self.first_row
        while len(todo):
            here = self.kept.get(rows)
            out[todo[here]] = self.samples[self.kept.rank(rows[here])] + walked
            todo, rows = todo[~here], rows[~here]
            symbol, before = self.tree.access(rows + self.first_row)
            rows = self.below[symbol] + before - self.first_row
            walked += 1
        return out

    def matching_statistics(self, symbols: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query that ends (exclusively) at `ends` in `symbols`: how many symbols back it still occurs at
        least twice, up to the threshold, and the rows [lo, hi) of what matched there. Every query's symbols are
        indexed themselves, so an interval of one is the query alone."""
        n = len(ends)
        length = np.zeros(n, np.int64)
        c = symbols[ends - 1].astype(np.int64)
        lo, hi = self.below[c], self.below[c + 1] if len(self.below) > c.max(initial=0) + 1 else np.append(self.below, self.first_row + len(symbols))[c + 1]
        todo = np.flatnonzero(hi - lo > 1)
        length[todo] = 1
        while len(todo) and length[todo[0]] < threshold:
            c = symbols[ends[todo] - 1 - length[todo]].astype(np.int64)
            a, b = self.tree.count(c, lo[todo], hi[todo])
            a, b = self.below[c] + a, self.below[c] + b
            more = b - a > 1
            todo = todo[more]
            lo[todo], hi[todo] = a[more], b[more]
            length[todo] += 1
        return length, lo, hi
