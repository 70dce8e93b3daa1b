"""A minimal perfect hash of 64-bit keys with the keys stored: n keys have the slots 0 to n - 1, any other key has none.

Keys are dealt to parts by their hash, so that tasks build the parts of a large set apart. Within a part each level has twice as many bits as
keys are left; a key that is alone at its bit owns it, the others go to the next level. A key's slot is the number of owned bits before its
own. A key that was not given may hit some key's bit: the key stored at the slot tells it apart. Lookups of many keys go level by level over
arrays, with no loop over keys.
"""

from __future__ import annotations

import numpy as np

from .words import M1, M2, mix

#: Levels of a part; keys still left then (as good as never) are an error.
LEVELS = 64


def _level(hashes: np.ndarray, level: int) -> np.ndarray:
    """32 bits for each hash, others at each level."""
    return mix(hashes + np.uint64((level + 1) * int(M2) & (1 << 64) - 1)) >> np.uint64(32)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys * M1) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: the bits of each level (their number), the bits of all levels as 64-bit words, and the keys by slot."""
    left, sizes, words, slots = np.sort(keys.astype(np.uint64)), [], [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys repeat")
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = (_level(left, len(sizes)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        owned = np.zeros(size, np.uint8)
        owned[at[alone]] = 1
        words.append(np.packbits(owned, bitorder="little").view("<u8"))
        slots.append(left[alone][np.argsort(at[alone])])
        sizes.append(size)
        left = left[~alone]
    empty = np.zeros(0, np.uint64)
    return np.array(sizes, np.int64), np.concatenate([empty, *words]), np.concatenate([empty, *slots])


class PerfectHash:
    """Lookups in the parts ``first`` and on, of ``parts`` that a set has; each is as ``build`` gives it, all bits empty where it has no keys."""

    def __init__(self, some: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int = 1, first: int = 0):
        sizes = np.zeros((len(some), max((len(p[0]) for p in some), default=0)), np.uint64)
        for i, (each, _, _) in enumerate(some):
            sizes[i, : len(each)] = each
        from_ = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
        bits = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in some)])
        keys = np.concatenate([np.zeros(0, np.uint64), *(p[2] for p in some)])
        ones = np.bitwise_count(bits).astype(np.int64)
        self._set(sizes, from_, bits, keys, np.cumsum(ones) - ones, parts, first)

    def _set(self, sizes, from_, bits, keys, before, parts, first) -> None:
        self.sizes, self.from_, self.bits, self.keys, self.before, self.parts, self.first = sizes, from_, bits, keys, before, parts, first

    def arrays(self) -> tuple:
        """What ``of`` makes the same lookups from, where this class is not known."""
        return self.sizes, self.from_, self.bits, self.keys, self.before, self.parts, self.first

    @classmethod
    def of(cls, arrays: tuple) -> PerfectHash:
        out = cls.__new__(cls)
        out._set(*arrays)
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the set."""
        out = np.full(len(keys), -1, np.int64)
        part = part_of(keys, self.parts) - self.first
        left = np.flatnonzero((part >= 0) & (part < len(self.sizes)))
        for level in range(self.sizes.shape[1] if len(self.keys) else 0):
            size = self.sizes[part[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.from_[part[left], level] + (_level(keys[left], level) * size >> np.uint64(32))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.bits[word]
            owned = (held >> bit) & np.uint64(1) == 1
            found = left[owned]
            below = held[owned] & ((np.uint64(1) << bit[owned]) - np.uint64(1))
            slot = self.before[word[owned]] + np.bitwise_count(below)
            same = self.keys[slot] == keys[found]
            out[found[same]] = slot[same]
            left = left[~owned]
        return out
