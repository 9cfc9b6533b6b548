"""A minimal perfect hash over a fixed set of byte strings, by collision-free levels.

Each level is a bit array; a key whose bit nobody else wants stays there, the others go on
to the next level. A key's number is the rank of its bit. Strings outside the set may get
a number too, so callers compare the string stored under it.
"""

from __future__ import annotations

import numpy as np
import xxhash

GAMMA = 2.0


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """numbers(keys) maps the keys of the set onto 0..n-1 without gaps; -1: surely not in the set."""

    def __init__(self, keys: list[bytes]) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        rest, level, before = hashes_of(keys), 0, 0
        if len(np.unique(rest)) < len(rest):
            raise ValueError("two keys are equal, or their 64-bit hashes are")
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = _places(rest, level, size)
            wanted = np.bincount(at, minlength=size)
            alone = wanted == 1
            self.levels.append((np.where(alone, before + np.cumsum(alone) - 1, -1).astype(np.int32), size))
            before += int(alone.sum())
            rest = rest[~alone[at]]
            level += 1
        self.count = before

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        hashes = hashes_of(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (rank, size) in enumerate(self.levels):
            got = rank[_places(hashes[left], level, size)]
            out[left] = got
            left = left[got < 0]
            if not len(left):
                break
        return out
