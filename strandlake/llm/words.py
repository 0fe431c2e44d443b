"""Words of many texts in one buffer, hashed by array operations instead of word by word."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed together, and the length from which words get XXH64 (a polynomial modulo 2^64 is weak on long texts).
BLOCK, LONG = 1 << 20, 64
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    if len(_tables.get(base, ())) < n:
        out = np.full(max(n, 4096), np.uint64(base))
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts (null: none), joined by single spaces.

    buffer holds all of them; starts and ends are their places in it, sizes the words of each text.
    """

    def __init__(self, texts: Iterable[str | None], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        parts = [b" ".join((r.lower() if lower else r).split()) for r in raw]  # bytes.lower() touches A-Z only
        self.sizes = np.array([p.count(b" ") + 1 if p else 0 for p in parts], "int64")
        self.buffer = b" ".join([p for p in parts if p])
        gaps = np.flatnonzero(np.frombuffer(self.buffer, np.uint8) == 32)
        self.starts = np.append(0, gaps + 1) if self.buffer else np.zeros(0, "int64")
        self.ends = np.append(gaps, len(self.buffer)) if self.buffer else np.zeros(0, "int64")
        self.first = np.cumsum(self.sizes) - self.sizes

    def hashes(self) -> np.ndarray:
        """64-bit hashes of all words."""
        out = np.zeros(len(self.starts), "uint64")
        data = np.frombuffer(self.buffer, np.uint8)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + BLOCK, "right")))
            at, to = self.starts[lo:hi] - self.starts[lo], self.ends[lo:hi] - self.starts[lo]
            n = int(to[-1])
            if n <= 2 * BLOCK:
                sums = np.zeros(n + 1, "uint64")
                np.cumsum((data[self.starts[lo] : self.starts[lo] + n].astype("uint64") + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
                out[lo:hi] = mix((sums[to] - sums[at]) * _powers(_INVERSE, n)[at] + (to - at).astype("uint64"))
            lo = hi
        for i in np.flatnonzero(self.ends - self.starts >= LONG):
            from xxhash import xxh64_intdigest

            out[i] = xxh64_intdigest(self.buffer[self.starts[i] : self.ends[i]])
        return out

    def slice(self, first: int, last: int) -> bytes:
        """Words first .. last - 1 with single spaces."""
        return self.buffer[self.starts[first] : self.ends[last - 1]] if last > first else b""


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes each; fewer words than k give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    out = np.zeros(n, "uint64")
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mix(out)


def span_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span first .. last - 1 of word hashes."""
    n = len(hashes)
    out = []
    for values in (hashes, mix(hashes ^ np.uint64(0x5851F42D4C957F2D))):
        sums = np.zeros(n + 1, "uint64")
        np.cumsum(values * _powers(_BASE, n), out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * _powers(_INVERSE, n + 1)[first] + (last - first).astype("uint64")))
    return out[0], out[1]


def bit_majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes the bits set in over half of them; none: zero.

    Eight byte counters stand in a word, so a bit is counted by word additions over at most 255 rows.
    """
    out = np.zeros(len(sizes), "<u8")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begins = np.cumsum(sizes) - sizes
    parts = -(-sizes[full] // 255)
    edge = np.repeat(begins[full], parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    counts = np.zeros((len(edge), 8, 8), "uint8")  # part, byte, bit
    ones = np.uint64(0x0101010101010101)
    for j in range(8):
        counts[:, :, j] = np.add.reduceat((hashes >> np.uint64(j)) & ones, edge).view("uint8").reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64).astype("int64"), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(total * 2 > sizes[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out
