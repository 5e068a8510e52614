"""Hashes of words and shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
#: Word hashes a worker keeps at hand; further words are hashed when they come.
KEPT_WORDS = 30_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


_WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text.

    A-Z count as a-z; words are what ASCII white space separates. With fewer than
    five words the whole sequence is one shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(WIDTH, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * _ODD + h[k : k + len(out)])
    return np.unique(out)
