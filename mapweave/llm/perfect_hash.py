"""Minimal perfect hashes with stored keys, in shards of bounded size.

A shard hashes its keys level by level: at a level each key that is left points at a bit; bits that one key alone points at are set and their keys are placed, the others go on with the next level. A key's slot
is the number of set bits before its own, so n keys have slots 0 .. n - 1. Slots hold the keys themselves, so a key that was never added is told from one that was. Everything is vectorised; integers are
mixed by a bijection, byte strings hashed, both under the level's number.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits a key at each level.
ROOM = 2
_A, _B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def hashed(keys, seed: int) -> np.ndarray:
    """64-bit hashes of an array of 64-bit integers, or of a list of byte strings."""
    if isinstance(keys, np.ndarray):
        x = keys.astype(np.uint64) + np.uint64((STEP * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def shard_of(keys, shards: int) -> np.ndarray:
    return (hashed(keys, 1 << 16) % np.uint64(shards)).astype(np.int64)


def _take(keys, at: np.ndarray):
    return keys[at] if isinstance(keys, np.ndarray) else [keys[i] for i in at.tolist()]


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], keys) -> None:
        """levels: set bits of each level; keys: by slot."""
        self.levels, self.keys = levels, keys
        ranks = np.cumsum(np.concatenate([np.zeros(1, bool), *levels]), dtype=np.int32)
        at = np.cumsum([0, *(len(x) for x in levels)])
        self.before = [ranks[a:b] for a, b in zip(at, at[1:], strict=False)]

    @classmethod
    def of(cls, keys) -> PerfectHash:
        """keys: distinct 64-bit integers (an array) or byte strings (a list)."""
        left, levels, order = np.arange(len(keys)), [], []
        while len(left):
            size = max(8, ROOM * len(left))
            spot = (hashed(_take(keys, left), len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            placed = alone[spot]
            order.append(left[placed][np.argsort(spot[placed])])
            levels.append(alone)
            left = left[~placed]
            if len(levels) > 1000:
                raise ValueError("keys repeat")
        return cls(levels, _take(keys, np.concatenate(order)) if order else keys)

    def find(self, keys) -> np.ndarray:
        """Slots; -1 for what is no key of this hash."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for seed, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            spot = (hashed(_take(keys, left), seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[spot]
            out[left[hit]] = before[spot[hit]]
            left = left[~hit]
            if not len(left):
                break
        found = np.flatnonzero(out >= 0)
        if isinstance(keys, np.ndarray):
            same = self.keys[out[found]] == keys[found]
        else:
            same = np.fromiter((self.keys[s] == keys[i] for i, s in zip(found.tolist(), out[found].tolist(), strict=True)), bool, len(found))
        out[found[~same]] = -1
        return out

    def dump(self) -> bytes:
        """The levels alone; keys are kept beside them."""
        sizes = np.array([len(self.levels), *(len(x) for x in self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes, keys) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, keys)
