"""A cuckoo filter of 128-bit keys: no false negatives, and keys can be taken out again."""

from __future__ import annotations

from collections import Counter

import numpy as np

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a fingerprint that finds no place goes to spare, which lookups read too."""

    def __init__(self, cells: np.ndarray, spare: list[int]):
        self.cells, self.spare = cells, spare
        self.mask = len(cells) - 1

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        n = 1
        while n * SLOTS * 0.8 < n_keys:
            n *= 2
        return cls(np.zeros((n, SLOTS), dtype=np.uint16), [])

    def load(self, more: int = 0) -> float:
        """The share of cells in use, were there `more` keys."""
        return (np.count_nonzero(self.cells) + len(self.spare) + more) / self.cells.size

    @classmethod
    def read(cls, cells: bytes, spare) -> CuckooFilter:
        return cls(np.frombuffer(cells, dtype=np.uint16).reshape(-1, SLOTS).copy(), [int(x) for x in spare])

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each key."""
        fp = (h2.astype(np.int64).view(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        fp[fp == 0] = 1
        first = (h1.astype(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.int64) & self.mask
        return fp, first, first ^ self.jump(fp)

    def jump(self, fp):
        return (fp * 0x5BD1E995) >> 7 & self.mask

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2))):
            self._put(fp, a, b)

    def _put(self, fp: int, a: int, b: int) -> None:
        for at in (a, b):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                return
        at = b
        for kick in range(KICKS):
            slot = (fp + kick) % SLOTS
            fp, self.cells[at, slot] = int(self.cells[at, slot]), fp
            at ^= int(self.jump(fp))
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                return
        self.spare.append(fp << 32 | at)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that were inserted."""
        spare = Counter(self.spare)
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2))):
            held = [x for x in (fp << 32 | a, fp << 32 | b) if spare[x] > 0]
            if held:
                spare[held[0]] -= 1
                continue
            for at in (a, b):
                found = np.flatnonzero(self.cells[at] == fp)
                if len(found):
                    self.cells[at, found[0]] = 0
                    break
        self.spare = list(spare.elements())

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h1, h2)
        found = (self.cells[a] == fp[:, None]).any(1) | (self.cells[b] == fp[:, None]).any(1)
        if self.spare:
            found |= np.isin(fp << 32 | a, self.spare) | np.isin(fp << 32 | b, self.spare)
        return found
