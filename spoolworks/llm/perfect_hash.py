"""A minimal perfect hash over distinct 64-bit keys, in NumPy (after Limasset et al., 2017).

A level is a bit array of twice the keys that are left; a key alone on its bit stays there, the others go to the next
level. A key's number is the rank of its bit among all levels, so n keys get 0 to n - 1 in about three bits each.
"""

from __future__ import annotations

import numpy as np

from spoolworks.llm.words import mixed

LOAD = 2
DEEPEST = 48
STEP = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64((level + 1) * STEP % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """sizes: bits of each level; bits: all levels in a row. Keys not built from get any number or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys, as uint64. Raises if two are the same."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == DEEPEST:
                raise ValueError("keys repeat")
            size = LOAD * len(left)
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _places(keys[open_], level, size) + base
            there = self.bits[at]
            found[open_[there]] = self.rank[at[there]]
            open_, base = open_[~there], base + size
        return found

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=sum(sizes))
        return cls(sizes, bits.astype(bool))
