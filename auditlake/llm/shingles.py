"""Word shingles of whole texts as sets of 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
REMEMBERED = 500_000  # words whose hash one Python worker keeps
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64's multipliers


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = number
        return number


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A number for each run of `size` words, in order; a shorter text is one run, an empty one has none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + h[k : len(h) - size + 1 + k])
    return total


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), size))
