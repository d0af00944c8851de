"""A minimal perfect hash of a fixed set of 64-bit keys: n keys, slots 0 to n - 1, about three bits a key."""

from __future__ import annotations

import numpy as np

from tidemark.llm.hashing import mix

#: Bits a level has per key that is still without a slot.
_ROOM = 2


def _positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = mix(keys + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Levels of bit sets. A key that alone hits a bit of a level has its slot there, the rank of that bit; keys
    that meet go on to the next level. Keys outside the set get some slot or -1, so slots must be verified."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys``: distinct, any 64-bit type."""
        left = np.ascontiguousarray(keys).view(np.uint64)
        self.size = len(left)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        first = 0
        while len(left):
            bits = -(-max(64, _ROOM * len(left)) // 64) * 64
            at = _positions(left, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((bits, words, first + np.cumsum(counts) - counts))
            first += int(counts.sum())
            left = left[~alone[at]]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, words, ranks) in enumerate(self.levels):
            at = _positions(keys[todo], level, bits)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out
