"""A cuckoo filter over 64-bit keys: four 16-bit tags to a bucket, insertion and deletion."""

from __future__ import annotations

import numpy as np

from sessionsift.llm.bytekit import mix

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """May report a key that isn't in it (about 1 in 8,000), never misses one that is."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (a power of two of buckets, SLOTS), 0: free

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        h = mix(keys.astype(np.uint64))
        tag = np.maximum(h >> np.uint64(48), np.uint64(1))
        first = h & mask
        return tag.astype(np.uint16), first.astype(np.int64), (first ^ (mix(tag) & mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        tag, a, b = self._places(keys)
        return (self.table[a] == tag[:, None]).any(axis=1) | (self.table[b] == tag[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew with more buckets."""
        rng = np.random.default_rng(len(keys))
        mask = len(self.table) - 1
        for tag, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = tag
                    break
            else:
                at = (a, b)[int(rng.integers(2))]
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    tag, self.table[at, slot] = int(self.table[at, slot]), tag
                    at ^= int(mix(np.array([tag], dtype=np.uint64))[0]) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = tag
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for tag, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == tag)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
