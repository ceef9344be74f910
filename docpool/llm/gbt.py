"""Gradient-boosted trees for small integer features, with logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: a node's feature and greatest bin that goes left; then the leaves' values."""

    features: np.ndarray
    splits: np.ndarray
    leaves: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class; x holds bins below BINS."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for features, splits, leaves in zip(self.features, self.splits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, features[at]] > splits[at])
            total += leaves[at - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 5, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Fits y (0 or 1) on bins x; without rows, or with one class only, a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, last = 2**depth - 1, 2**depth
    features, splits, leaves = (np.zeros((trees, n), t) for n, t in ((inner, np.int64), (inner, np.int64), (last, np.float64)))
    splits[:] = BINS
    score = np.full(len(y), base)
    for t in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = at - first
            for f in range(x.shape[1]):
                slot = local * BINS + x[:, f]
                gs = np.bincount(slot, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(slot, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                cut = gain.argmax(1)
                value = gain[np.arange(width), cut]
                better = value > best
                best[better] = value[better]
                features[t, first : first + width][better] = f
                splits[t, first : first + width][better] = cut[better]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[t, at]] > splits[t, at])
        leaf = at - inner
        leaves[t] = -rate * np.bincount(leaf, g, last) / (np.bincount(leaf, h, last) + ridge)
        score += leaves[t][leaf]
    return Trees(features, splits, leaves, base)
