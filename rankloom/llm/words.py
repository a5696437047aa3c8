"""Words of a text column as 64-bit hashes, in numpy: no Python code runs for each word.

A word is a run of bytes of a class that holds every byte of the non-ASCII code points or none of them, so runs of
UTF-8 bytes are runs of code points. A hash is a sum of byte values times random 64-bit factors of their places in
the word, mixed at the end; A-Z count as a-z.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of a text whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_factors = np.empty(0, np.uint64)


def _places(n: int) -> np.ndarray:
    global _factors
    if len(_factors) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        _factors = np.random.Generator(np.random.PCG64(20231)).integers(0, 1 << 64, size, np.uint64, endpoint=False) | np.uint64(1)
    return _factors[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (one more: the end)."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """hash, start and end (bytes) of every word; first[i]:first[i + 1] are those of text i."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        self.data, at = raw(texts)
        n = len(self.data)
        inside = kind[self.data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        after[at[1:][at[1:] > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        if len(self.start) == 0:
            self.hash = np.empty(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            length = self.end - self.start
            place = np.arange(n)
            place -= np.repeat(np.concatenate([[0], self.start]), np.diff(np.concatenate([[0], self.start, [n]])))
            place[~inside] = 0
            value = (LOWER[self.data].astype(np.uint64) + np.uint64(1)) * inside
            value *= _places(int(length.max()) + 1)[place]
            self.hash = mix(np.add.reduceat(value, self.start) ^ (length.astype(np.uint64) << np.uint64(40)))

    def text(self, i: int) -> bytes:
        """The lower-cased bytes of word i."""
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


@lru_cache(8)
def _slots(k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, k, np.uint64, endpoint=False) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a text with fewer, but not none, has one: the whole."""
    if len(hashes) == 0:
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < k:
            return mix((hashes * _slots(k)[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
        out = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            out += hashes[j : j + len(out)] * _slots(k)[j]
        return mix(out)
