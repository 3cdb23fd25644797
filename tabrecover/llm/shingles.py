"""Words and five-word shingles of whole texts as hashes, inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)
_hash = xxhash.xxh3_64_intdigest


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return); only A-Z become lower case."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words, none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _FACTORS[i]
    return mixed(total)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words has its whole sequence as the only one."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < width:
        return np.array([_hash(b" ".join(found), len(found))], np.uint64)
    return np.unique(rolling(word_hashes(found), width))
