"""SetSketch registers of word-shingle sets: mergeable, locality-sensitive.

Every register draws an exponential variate for each element and keeps the
smallest one, rounded to a whole power of ``BASE`` and truncated to 16 bits.
Two registers of sets with Jaccard similarity J agree with probability about
J, so runs of them (bands) serve as bucket keys; and the registers of two sets
that differ up, down or not at all give a likelihood for J.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np

from .common import mix, word_hashes

WORDS = 5
BASE = 1.001
RATE = 20.0
ROWS = 4
BANDS = 40
REGISTERS = ROWS * BANDS
_TOP = 65_535

_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2)
_ODD = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: runs of five words of the
    text with A-Z lower-cased; all its words as one run where they are fewer;
    none for a text without words or a null."""
    words, counts = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * _PLACE[k]
    runs = mix(runs)
    out, start = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(runs[start : start + n - WORDS + 1]))
        elif n:
            with np.errstate(over="ignore"):
                whole = (words[start : start + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        start += n
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers (uint16) for each set, none of them empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _ODD[j], starts)
    return registers(least)


def registers(least: np.ndarray) -> np.ndarray:
    """Registers of the smallest 64-bit hash values."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(exponential / RATE) / log(BASE)), 0, _TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    grouped = np.ascontiguousarray(rows).view(np.uint64).reshape(len(rows), BANDS)
    return mix(grouped * np.uint64(0x9E3779B97F4A7C15) ^ _BAND).view(np.int64)


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity for pairs of rows of registers
    with known set sizes, from how many registers are larger in a, larger in b,
    or equal. The likelihood has one maximum; it is bracketed by thirds."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u

    def chance(x):
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / log(BASE), 1e-300, 1)

    def likelihood(j):
        more, less = chance(u - v * j), chance(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-300, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(22):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct sets."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    places = np.searchsorted(large, small)
    places[places == len(large)] = 0
    shared = int((large[places] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)
