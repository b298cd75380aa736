"""Word ids and rolling word-shingle hashes that the text matchers share."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their character spans."""
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [text[s:e].lower() for s, e in found], found


def ids(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """Word ids of a text; words that are not in the vocabulary are -1."""
    get = vocabulary.get
    return np.array([get(w, -1) for w in _WORD.findall(text.lower())], np.int64)


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each k consecutive ids; 0 where one of them is -1."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(k):
        h = h * _STEP + u[j : j + n]
        known &= x[j : j + n] >= 0
    h ^= h >> np.uint64(31)
    return np.where(known, h | np.uint64(1), np.uint64(0))
