"""An immutable hash table of 64-bit keys for vectorised lookups."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.iinfo("int64").min


def combine(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key from several; the order matters."""
    with np.errstate(over="ignore"):
        out = parts[0].astype("int64").view("uint64")
        for p in parts[1:]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + p.astype("int64").view("uint64")
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (out ^ (out >> np.uint64(29))).view("int64")


class HashIndex:
    """Values by distinct 64-bit keys, about three quarters full, with linear probing."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        keys = np.where(keys == _FREE, _FREE + 1, keys.astype("int64"))
        self.size = size = max(16, len(keys) * 4 // 3 + 1)
        self.keys = np.full(size, _FREE)
        at = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = self.keys[at[waiting]] == _FREE
            self.keys[at[waiting[free]]] = keys[waiting[free]]
            waiting = waiting[self.keys[at[waiting]] != keys[waiting]]
            at[waiting] = (at[waiting] + 1) % size
        self.values = []
        for v in values:
            held = np.zeros(size, v.dtype)
            held[at] = v
            self.values.append(held)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            high = (keys.view("uint64") * _MIX) >> np.uint64(32)
            return ((high * np.uint64(self.size)) >> np.uint64(32)).astype("int64")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where it is missing."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        open_ = np.flatnonzero((held != keys) & (held != _FREE))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.size
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held != _FREE)]
        return out
