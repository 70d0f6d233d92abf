"""Words and word shingles inside Python workers, by the same rules as the column expressions in ``common``."""

from __future__ import annotations

import hashlib

import numpy as np

#: A-Z in lower case, other ASCII than letters and digits as a blank; bytes above ASCII are parts of words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Multipliers of the five places of a shingle, odd and fixed.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bounded number (some 200 bytes each in every Python worker)."""

    def __init__(self, cached: int = 100_000):
        super().__init__()
        self.cached = cached

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.cached:
            self[word] = value
        return value


def shingles(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words make one run, none an empty array."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    run = min(width, len(words))
    total = np.full(len(words) - run + 1, run, dtype=np.uint64)
    for k in range(run):
        place = np.uint64(_PLACES[k % 5]) * np.uint64(2 * (k // 5) + 1)
        total += h[k : len(words) - run + 1 + k] * place
    return np.unique(mixed(total))
