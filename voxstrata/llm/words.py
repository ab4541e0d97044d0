"""Words and shingle hashes of texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(31)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, kept for the words seen lately."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def shingles_at(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` words, by place; with fewer words the whole run is one; without words none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    h = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        h = mix(h * _M3 + hashes[k : n - size + 1 + k])
    return h
