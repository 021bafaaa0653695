"""Minimal perfect hashes of a fixed set of keys, in numpy.

Keys go through levels of bit arrays. At each level a key whose place nobody else of the level takes sets that bit; the
others go on. A key's slot is the number of bits set before its own, so n keys fill the slots 0 to n - 1. The keys are kept
by slot: a key outside the set may meet a set bit, and only the stored key tells.
"""

from __future__ import annotations

import numpy as np
import xxhash

from martlet.llm import wordhash

#: Bits of a level for each key that reaches it.
ROOM = 2
_STEP = 0x9E3779B97F4A7C15


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)


class PerfectHash:
    """Built from distinct keys. `find` gives the slots of keys, -1 for keys outside the set."""

    def __init__(self, keys: list[bytes]) -> None:
        values = hashes(keys)
        _, first = np.unique(values, return_index=True)
        twins = np.setdiff1d(np.arange(len(keys)), first)  # keys whose whole hash another key has
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits, and the slot of each word's first bit
        slot, left, filled = np.empty(len(keys), dtype=np.int64), first, 0
        while len(left):
            words = -(-ROOM * len(left) // 64)
            at = self._place(values[left], len(self.levels), words)
            taken = np.bincount(at, minlength=64 * words)
            alone = taken[at] == 1
            bits = np.zeros(words, dtype=np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            before = filled + np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.int64)
            self.levels.append((bits, before))
            slot[left[alone]] = self._rank(bits, before, at[alone])
            filled, left = filled + int(alone.sum()), left[~alone]
        slot[twins] = filled + np.arange(len(twins))
        self.twins = {keys[i]: int(slot[i]) for i in twins}
        by_slot = np.argsort(slot, kind="stable")
        self.offsets = np.concatenate([[0], np.cumsum([len(keys[i]) for i in by_slot])]).astype(np.int64)
        self.stored = b"".join(keys[i] for i in by_slot)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def _place(values: np.ndarray, level: int, words: int) -> np.ndarray:
        return (wordhash.mix(values + np.uint64((level + 1) * _STEP % 2**64)) % np.uint64(64 * words)).astype(np.int64)

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = bits[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(below).astype(np.int64)

    def key(self, slot: int) -> bytes:
        return self.stored[self.offsets[slot]:self.offsets[slot + 1]]

    def find(self, keys: list[bytes], values: np.ndarray | None = None) -> np.ndarray:
        values = hashes(keys) if values is None else values
        slot, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self._place(values[left], level, len(bits))
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slot[left[hit]] = self._rank(bits, before, at[hit])
            left = left[~hit]
        some = np.flatnonzero(slot >= 0)
        lengths = self.offsets[slot[some] + 1] - self.offsets[slot[some]]
        for i, start, n in zip(some.tolist(), self.offsets[slot[some]].tolist(), lengths.tolist()):
            if len(keys[i]) != n or not self.stored.startswith(keys[i], start):
                slot[i] = -1
        if self.twins:
            for i in np.flatnonzero(slot < 0).tolist():
                slot[i] = self.twins.get(keys[i], -1)
        return slot
