"""Words and word shingles of texts as 64-bit hashes, computed with numpy inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit multiplier of the shingle hash (2 ** 64 over the golden ratio).
PHI = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word met lately; emptied when full, so memory is bounded. Travels empty."""

    def __reduce__(self):
        return _Hashes, ()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8, with A-Z lower-cased; white space is that of GAP in common."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, in order; of a shorter text, that of all of it."""
    n = len(ids)
    width = min(width, n)
    out = np.full(max(n - width + 1, 0) if n else 0, width, np.uint64)
    for k in range(width):
        out ^= ids[k : n - width + 1 + k]
        out *= PHI
        out ^= out >> np.uint64(31)
    return out
