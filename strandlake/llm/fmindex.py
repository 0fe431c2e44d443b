"""A compressed FM-index over integer sequences: wavelet matrix, bit-packed, with vectorised search."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(((n >> 6) + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="int64")])[:-1].astype("int32" if n < 2**31 else "int64")

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype("uint64")) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """rank(c, i): how often c stands before position i."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        v = values
        for level in range(self.levels - 1, -1, -1):
            b = ((v >> level) & 1).astype(np.uint8)
            self.bits.append(BitRank(b))
            self.zeros.append(int(len(b) - b.sum()))
            v = np.concatenate([v[b == 0], v[b == 1]])

    def ranks(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.zeros(len(c), "int64")
        lo, hi = lo.astype("int64"), hi.astype("int64")
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            r0, r1, r2 = bits.rank(base), bits.rank(lo), bits.rank(hi)
            base = np.where(one, zeros + r0, base - r0)
            lo = np.where(one, zeros + r1, lo - r1)
            hi = np.where(one, zeros + r2, hi - r2)
        return lo - base, hi - base


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least (prefix doubling), then by place."""
    n = len(text)
    rank = text.astype("int64")
    order = np.argsort(rank, kind="stable")
    done = 1
    while done < depth:
        later = np.zeros(n, "int64")
        later[: n - done] = rank[done:] + 1
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key, kind="stable")
        ks = key[order]
        rank = np.empty(n, "int64")
        rank[order] = np.concatenate([[0], np.cumsum(ks[1:] != ks[:-1])])
        done *= 2
        if int(rank[order[-1]]) == n - 1:
            break
    return order


class FMIndex:
    """Backward search for patterns of at most `depth` symbols; symbols are 0 .. sigma - 1.

    The suffix array isn't kept. What a search reports is the smallest of the `labels` of the places
    in an interval, so the labels' ranks stand in suffix order instead, in 32 bits or fewer.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int, labels: np.ndarray | None = None):
        order = suffix_order(text, depth + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1].astype("int64"), sigma)
        if labels is not None:
            self.values, ranks = np.unique(labels, return_inverse=True)
            self.labels = ranks[order].astype("uint16" if len(self.values) <= 1 << 16 else "uint32")

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest label of each interval lo .. hi - 1; intervals are in order and apart."""
        ranks = np.append(self.labels, 0)  # the last end may be the length
        return self.values[np.minimum.reduceat(ranks, np.stack([lo, hi], 1).ravel())[::2]]

    def statistics(self, text: np.ndarray, at: np.ndarray, depth: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward from each window text[p : p + depth]: (matched length, lo, hi).

        The matched length is that of the longest suffix of the window with `least` occurrences in
        the index; lo and hi bound the suffix-array interval of what matched. A window stops as
        soon as it falls below.
        """
        c = text[at + depth - 1]
        lo, hi = self.first[c].astype("int64"), self.first[c + 1].astype("int64")
        length = np.where(hi - lo >= least, 1, 0)
        live = np.flatnonzero(length)
        for step in range(depth - 2, -1, -1):
            if not len(live):
                break
            c = text[at[live] + step]
            a, b = self.bwt.ranks(c, lo[live], hi[live])
            a, b = a + self.first[c], b + self.first[c]
            ok = b - a >= least
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            length[live] += 1
        return length, lo, hi
