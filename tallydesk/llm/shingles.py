"""Sets of word shingles and their hashes, for tasks that run in Python."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_CACHED_WORDS = 400_000


def words(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z; runs without ASCII white space."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, width: int) -> set:
    """The distinct runs of ``width`` words; a shorter text is one run, an empty one has none."""
    found = words(text)
    if len(found) < width:
        return {tuple(found)} if found else set()
    return set(zip(*(found[n:] for n in range(width)), strict=False))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the common ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def shingles(self, text: bytes | None, width: int) -> np.ndarray:
        """The hashes of ``shingle_set``, sorted."""
        found = words(text)
        if not found:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        width = min(width, len(codes))
        rows = len(codes) - width + 1
        mixed = np.zeros(rows, np.uint64)
        for n in range(width):
            mixed = (mixed ^ codes[n : n + rows]) * _MIX
            mixed ^= mixed >> _SHIFT
        return np.unique(mixed)
