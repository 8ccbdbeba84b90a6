"""A compressed FM-index over word codes: BWT in a wavelet tree of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector that counts ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(bits.size + 1) // 64) * 64, np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64))).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Codes level by level, the highest bit first; on each level zeros stand before ones."""

    def __init__(self, codes: np.ndarray, n_codes: int):
        self.depth = max(1, int(n_codes - 1).bit_length())
        self.levels, self.zeros = [], []
        rest = codes
        for level in range(self.depth - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(bit.size - bit.sum()))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))

    def count(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each code the number of its occurrences before lo and before hi."""
        base = np.zeros_like(lo)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (codes >> (self.depth - 1 - level)) & 1 == 1
            lo_ones, hi_ones, base_ones = bits.ones(lo), bits.ones(hi), bits.ones(base)
            lo = np.where(one, zeros + lo_ones, lo - lo_ones)
            hi = np.where(one, zeros + hi_ones, hi - hi_ones)
            base = np.where(one, zeros + base_ones, base - base_ones)
        return lo - base, hi - base


def _ranks(high: np.ndarray, low: np.ndarray, top: int) -> np.ndarray:
    """Dense ranks of the pairs (high, low), all below top."""
    key = high * np.int64(top) + low
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(key.size, np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(key.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    if by < rank.size:
        out[: rank.size - by] = rank[by:]
    return out


class FMIndex:
    """Index of a code sequence for patterns of up to ``depth`` codes; code 0 separates texts and is never searched.

    Suffixes are ordered by their first ``depth`` codes, which is all that patterns of that length can tell apart.
    """

    def __init__(self, codes: np.ndarray, n_codes: int, depth: int):
        n = codes.size
        rank, span = codes.astype(np.int64), 1
        while span * 2 < depth:
            rank, span = _ranks(rank, _ahead(rank, span), n + n_codes + 1), span * 2
        shorter = _ranks(rank, _ahead(rank, depth - 1 - span), n + n_codes + 1)
        whole = _ranks(rank, _ahead(rank, depth - span), n + n_codes + 1)
        self.order = np.argsort(whole, kind="stable")
        self.tree = WaveletTree(codes[self.order - 1], n_codes)
        counts = np.bincount(codes, minlength=n_codes)
        self.start = np.concatenate(([0], np.cumsum(counts)))
        # Where the class of suffixes with the same first depth - 1 codes begins and ends.
        ordered = shorter[self.order]
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        of = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        self.class_lo = edge[of]
        self.class_hi = np.append(edge[1:], n)[of]

    def extend(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of code + pattern from intervals of the patterns."""
        before, upto = self.tree.count(codes, lo, hi)
        return self.start[codes] + before, self.start[codes] + upto

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first depth - 1 codes of patterns whose intervals begin at lo."""
        return self.class_lo[lo], self.class_hi[lo]
