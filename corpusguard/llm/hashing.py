"""Vectorized hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# Words remembered by a task before it starts afresh.
REMEMBERED = 2_000_000


class WordHashes(dict):
    """64-bit hash of each word, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * _STEP
    return values ^ (values >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of `length` words, by its start; none if there are fewer words."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(length):
        total = (total * _STEP) + words[k : k + count]
    return mix(total)
