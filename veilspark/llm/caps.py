"""Spherical-cap filters from structured random product codes.

A code is a random rotation and, for each half of the coordinates, a list of
random codewords. Its filter directions are all pairs of codewords, so s
codewords a half give s * s directions, but a vector's inner products with all
of them are sums of two short tables. A vector is in the filter of every
direction whose cap holds it; the entries of either table that can still reach
the cap with the other's best are few, and only those are paired.

Caps cover a share of the sphere that falls with the number of vectors, so
that unrelated vectors seldom meet in a filter, and the number of codewords
rises so that a vector is in about ``FILTERS`` filters. Several codes even out
how many filters a vector gets.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np

CODES = 16
FILTERS = 55
#: Unrelated vectors in a filter on average, unless the share ends first.
CROWD = 0.25
#: Largest and smallest share of a cap (2 to this power). Below the smallest,
#: tables of codewords would cost more than meeting by chance.
SHARES = (-12, -23)
#: A cap begins at this inner product at the farthest.
FARTHEST = 0.7


def share_for(vectors: int) -> float:
    """The share of the sphere a cap should cover: a power of two."""
    return 2.0 ** min(SHARES[0], max(SHARES[1], -ceil(log2(max(1, vectors) / CROWD))))


def _tail(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products t in rising order and the shares of the caps from t on."""
    if dimensions < 2:
        return np.array([-1.0, 1.0]), np.array([1.0, 0.5])
    # in the angle, the density is a power of its sine
    angle = np.linspace(0, np.pi, 200_001)
    density = np.sin(angle) ** (dimensions - 2)
    inside = np.cumsum(density)
    return np.cos(angle)[::-1], (inside / inside[-1])[::-1]


class ProductCodes:
    def __init__(self, dimensions: int, share: float = 2.0 ** SHARES[0], codes: int = CODES, filters: float = FILTERS, seed: int = 64):
        rng = np.random.default_rng([seed, dimensions])
        at, shares = _tail(dimensions)
        self.least = min(FARTHEST, float(at[np.flatnonzero(shares >= share)[-1]]))
        share = max(share, float(shares[np.searchsorted(at, self.least)]))
        self.size = max(2, round(np.sqrt(filters / (codes * share))))
        cut = (dimensions + 1) // 2
        self.tables = []
        for _ in range(codes):
            rotation, _ = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))
            halves = []
            for part in (rotation[:, :cut], rotation[:, cut:]):
                words = rng.normal(size=(self.size, part.shape[1]))
                if words.size:
                    words *= np.sqrt(part.shape[1] / dimensions) / np.linalg.norm(words, axis=1, keepdims=True)
                halves.append(part @ words.T)
            self.tables.append(halves)

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the filters each unit vector is in."""
        found: list[list[np.ndarray]] = [[] for _ in unit]
        for code, (first, second) in enumerate(self.tables):
            left, right = unit @ first, unit @ second
            heads = left >= self.least - right.max(axis=1, keepdims=True)
            tails = right >= self.least - left.max(axis=1, keepdims=True)
            for row in np.flatnonzero(heads.any(axis=1)).tolist():
                a, b = np.flatnonzero(heads[row]), np.flatnonzero(tails[row])
                i, j = np.nonzero(left[row, a][:, None] + right[row, b] >= self.least)
                found[row].append((code * self.size + a[i]) * self.size + b[j])
        return [np.sort(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]
