"""Minimal perfect hash functions over distinct 63-bit keys, in shards of their own, looked up a whole array at a time.

A key's hash names its shard. A shard's keys are hashed into a bit field twice their number; a bit that exactly one key
hits is set and settles that key, the others go on to a further field with another seed, until none is left. The place of
a key is the number of set bits before its own, so n keys have the places 0 .. n - 1. A key that was not in the set can
land anywhere, so whatever stands at a place is kept with its key and compared.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of integers."""
    x = x.astype(np.uint64) + np.uint64((_GOLDEN * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each key."""
    return (mix(keys) % np.uint64(n_shards)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of the fields, their bits laid end to end, the keys in order of their places) for distinct keys."""
    left, sizes, fields = keys, [], []
    while len(left):
        size = max(8, 2 * len(left))
        at = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        fields.append(once)
        left = left[~once[at]]
    bits = np.concatenate(fields) if fields else np.zeros(0, dtype=bool)
    placed = np.empty(len(keys), dtype=np.int64)
    placed[PerfectHash([sizes], [bits], [len(keys)]).places(keys)] = keys
    return sizes, bits, placed


class PerfectHash:
    """The functions of all shards (in order, none missing; an empty shard has no fields) as one."""

    def __init__(self, sizes: list[list[int]], bits: list[np.ndarray], counts: list[int]):
        self.n_shards = len(sizes)
        levels = max(map(len, sizes), default=0)
        self.size = np.zeros((levels, self.n_shards), dtype=np.int64)
        self.start = np.zeros((levels, self.n_shards), dtype=np.int64)
        at = 0
        for s, some in enumerate(sizes):
            for level, size in enumerate(some):
                self.size[level, s], self.start[level, s] = size, at
                at += size
        self.bits = np.concatenate([*bits, np.zeros(1, dtype=bool)])
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits
        self.n_keys = sum(counts)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; for keys outside the set some place, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest, shard = np.arange(len(keys)), shard_of(keys, self.n_shards) if self.n_shards > 1 else np.zeros(len(keys), dtype=np.int64)
        for level in range(len(self.size)):
            size = self.size[level, shard[rest]]
            rest, size = rest[size > 0], size[size > 0]
            if not len(rest):
                break
            at = self.start[level, shard[rest]] + (mix(keys[rest], level + 1) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            out[rest[hit]] = self.before[at[hit]]
            rest = rest[~hit]
        return out
