"""A minimal perfect hash over 64-bit keys, in numpy, and tables of two-part keys by its slots."""

from __future__ import annotations

from itertools import count

import numpy as np

from corvane.llm.common import mix


class PerfectHash:
    """Distinct uint64 keys to 0, 1, ..., n - 1. In each level a key takes a place of its own by hash; keys that meet go
    on to the next level. A slot is the rank of the place among those taken. Other keys get any slot, or -1."""

    def __init__(self, keys: np.ndarray):
        levels = []
        while keys.size:
            at = _places(keys, len(levels), 16 * (keys.size // 8 + 1))
            alone = np.bincount(at, minlength=16 * (keys.size // 8 + 1)) == 1
            levels.append(np.packbits(alone))
            keys = keys[~alone[at]]
        self.__setstate__(levels)

    def __getstate__(self) -> list[np.ndarray]:
        return self._bits

    def __setstate__(self, bits: list[np.ndarray]) -> None:
        self._bits, self._levels, n = bits, [], 0
        for x in bits:
            taken = np.unpackbits(x).view(bool)
            self._levels.append((taken, n + np.cumsum(taken) - 1))
            n += int(taken.sum())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot, left = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for i, (taken, rank) in enumerate(self._levels):
            at = _places(keys[left], i, taken.size)
            hit = taken[at]
            slot[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return slot


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) % np.uint64(size)).astype(np.int64)


class SlotTable:
    """Two-part keys (uint64, uint32) by slot. The parts are stored, so a key that is not there is known as such."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        for self.seed in count():
            one, first = np.unique(self._one(a, b), return_index=True)
            self.hash = PerfectHash(one)
            self.a, self.b, self.first = np.empty(one.size, np.uint64), np.empty(one.size, np.uint32), np.empty(one.size, np.int64)
            slot = self.hash(one)
            self.a[slot], self.b[slot], self.first[slot] = a[first], b[first], first
            if (self.slots(a, b) >= 0).all():  # no two keys are one under this seed
                return

    def _one(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a + np.uint64((0x9E3779B97F4A7C15 * self.seed) % 2**64)) ^ mix(b.astype(np.uint64) + np.uint64(self.seed))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not stored."""
        if not self.a.size:
            return np.full(a.size, -1, np.int64)
        slot = self.hash(self._one(a, b))
        return np.where((slot >= 0) & (self.a[slot] == a) & (self.b[slot] == b), slot, -1)

    def counts(self, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of n by slot; exact below 2^53."""
        return np.bincount(slots, n, self.a.size).astype(np.int64)
