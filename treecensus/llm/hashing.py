"""Minimal perfect hashing of distinct 64-bit keys, in numpy.

Level after level, the keys that share no bit of a bit array with another one are settled by it; the
others go to the next level.  A key's place is the number of set bits before its own, so n keys have
the places 0 to n - 1 without gaps, whatever the keys.  A foreign key has some place or none; the key
stored at a place tells whether it was meant.
"""

from __future__ import annotations

import numpy as np

#: Bits for each key that is left at a level.
ROOM = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one mixing of 64-bit integers, another one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """``levels`` are bit arrays; ``find`` gives the places of keys, -1 for those that no level settles."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.cumsum(bits) for bits in levels]
        starts = np.cumsum([0, *(int(c[-1]) for c in counts)])
        self.before = [c.astype(np.int64) - bits + start for c, bits, start in zip(counts, levels, starts)]
        self.size = int(starts[-1])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels, left = [], keys
        while len(left):
            m = ROOM * len(left)
            at = (mixed(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = (mixed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def stored(self) -> list[bytes]:
        """The bit arrays, packed, each after its number of bits."""
        return [len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def loaded(cls, stored: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool)
                    for b in stored])
