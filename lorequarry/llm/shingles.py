"""Word n-gram hashes of texts, many texts at a time."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_END = np.uint64(0x5851F42D4C957F2D)
#: Words whose hashes a worker keeps; beyond, it begins anew.
CACHE_WORDS = 400_000


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_CACHE = _Hashes()


def hashes_of(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in one array, and each text's number of words."""
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    n = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(map(_CACHE.__getitem__, chain.from_iterable(each)), np.uint64, int(n.sum())), n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, of all texts in one array, and each text's number of words."""
    return hashes_of([t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts])  # on bytes, both touch ASCII only


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that begins at each word; the last n - 1 are cut off by the array's end. Fewer than n words have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k] * _K[k % 5])
    return out


def shingle_sets(texts: list[str | None], n: int = 3) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; fewer than n words are one shingle, no word none."""
    words, counts = word_hashes(texts)
    grams = ngram_hashes(words, n)
    ends = np.cumsum(counts)
    out = []
    for end, k in zip(ends.tolist(), counts.tolist(), strict=True):
        if k >= n:
            out.append(np.unique(grams[end - k : end - n + 1]))
        elif k:
            out.append(ngram_hashes(np.append(words[end - k : end], np.full(n - k, _END)), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
