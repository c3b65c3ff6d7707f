"""A minimal perfect hash table over 128-bit digests, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

#: Places offered to each key on a level; more places mean fewer levels.
ROOM = 1.5
LEVELS = 200


def _place(k1: np.ndarray, k2: np.ndarray, level: int, places: int) -> np.ndarray:
    x = k1 ^ (k2 * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(places)).astype(np.int64)


class SlotTable:
    """Each of n different digests has its own slot from 0 to n - 1.

    On each level the keys left are hashed to places; a key alone in its place gets the next slot, the others go
    on to the next level. The table keeps each slot's digest, so a lookup of any other digest is found out.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray) -> None:
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        self.size, self.levels = len(k1), []
        self.slots = np.full(self.size, -1, np.int64)
        left, taken = np.arange(self.size), 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("digests repeat")
            places = max(2, int(ROOM * len(left)))
            at = _place(k1[left], k2[left], len(self.levels), places)
            alone = np.bincount(at, minlength=places) == 1
            slot = np.where(alone, np.cumsum(alone) - 1 + taken, -1)
            self.levels.append(slot)
            mine = slot[at]
            self.slots[left[mine >= 0]] = mine[mine >= 0]
            taken, left = taken + int(alone.sum()), left[mine < 0]
        if not (np.bincount(self.slots, minlength=self.size) == 1).all():
            raise AssertionError("slots are not a permutation")
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[self.slots], self.k2[self.slots] = k1, k2

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        out, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, slot in enumerate(self.levels):
            got = slot[_place(k1[left], k2[left], level, len(slot))]
            out[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        met = out >= 0
        met[met] = (self.k1[out[met]] == k1[met]) & (self.k2[out[met]] == k2[met])
        return np.where(met, out, -1)
