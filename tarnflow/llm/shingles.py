"""Word shingles of whole texts as 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, dtype=np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    word = _IS_WORD[data]
    at = np.flatnonzero(word)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    lengths = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTE[data[at]] * _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    upto = np.searchsorted(at[first], ends)
    return hashes, np.diff(np.r_[0, upto])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct ``k``-word shingles; with fewer words the whole sequence as one; none without words."""
    words, counts = word_hashes(texts)
    n = len(words)
    rolled = words * np.uint64(3)
    for i in range(1, k):
        rolled = mix(rolled[: n - i] + _STEP) * np.uint64(5) + words[i:] if n > i else rolled[:0]
    rolled = mix(rolled)
    sets, start = [], 0
    for count in counts.tolist():
        if count >= k:
            sets.append(np.unique(rolled[start : start + count - k + 1]))
        elif count:
            whole = np.full(1, count, np.uint64)
            for i in range(start, start + count):
                whole = mix(whole * np.uint64(7) + words[i : i + 1])
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
        start += count
    return sets
