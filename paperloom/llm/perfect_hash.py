"""Minimal perfect hashing of distinct 64-bit keys by levels of bits.

At each level the keys left are hashed into a bit array; positions hit by exactly one key are
set, and the other keys go to the next level.  The slot of a key is the number of bits set
before its own, so ``n`` keys have the slots ``0 .. n - 1``.  A key that was not among them may
get any slot or none, so whoever looks up also compares the key stored there.
"""

from __future__ import annotations

import numpy as np

from paperloom.llm.batches import mix

SPACE = 1.5  # bits of a level for each key left
LEVELS = 200


def positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """One array of 64-bit words per level; the keys must be distinct."""
    levels, left = [], keys.astype(np.uint64)
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-int(len(left) * SPACE) // 64) * 64 + 64
        at = positions(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    return levels


def pack(levels: list[np.ndarray]) -> bytes:
    sizes = np.array([len(levels), *map(len, levels)], np.uint64)
    return np.concatenate([sizes, *levels]).tobytes()


def unpack(data: bytes) -> list[np.ndarray]:
    words = np.frombuffer(data, np.uint64)
    ends = np.cumsum(words[1:int(words[0]) + 1].astype(np.int64)) + 1 + int(words[0])
    return [words[e - int(n):e] for e, n in zip(ends, words[1:int(words[0]) + 1])]


class Slots:
    """Looks up the slots of keys in the levels of one hash."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels, self.before, total = levels, [], 0
        for words in levels:
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(np.concatenate([[total], ones[:-1] + total]))
            total += int(ones[-1])
        self.size = total

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = positions(keys[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)) == 1
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before[at[hit] >> 6] + np.bitwise_count(lower)
            left = left[~hit]
        return out
