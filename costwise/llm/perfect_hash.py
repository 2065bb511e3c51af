"""A minimal perfect hash over 128-bit keys, in numpy.

Levels of bit arrays: every key falls on one place of a level; keys alone on
their place stay there, the others go on to the next level. A key's slot is
the number of set bits before its place over all levels, so n keys get the
slots 0 to n - 1 and no key is stored.
"""

from __future__ import annotations

import numpy as np

_GAMMA, _MAX_LEVELS = 2, 64
_C = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """(n, 2) uint64 keys -> places; another mix of both halves on each level."""
    h = keys[:, 0] ^ (keys[:, 1] + np.uint64((level + 1) * _C % 2**64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits: uint8, packed, all levels one after the other
        flags = np.unpackbits(bits)
        self.flags = flags.astype(bool)
        self.rank = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        self.n = int(self.rank[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct rows of (n, 2) uint64."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == _MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, _GAMMA * len(left))
            at = _place(left, len(sizes), size)
            n = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(n == 1)
            left = left[n[at] != 1]
        return cls(sizes, np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level holds it (then it is surely foreign)."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[todo], level, size) + base
            hit = self.flags[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo, base = todo[~hit], base + size
            if not len(todo):
                break
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<i8").tobytes()
        return head + self.bits.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
        return cls(sizes, np.frombuffer(raw, np.uint8, offset=8 * (n + 1)))
