"""Gradient-boosted trees for two classes, on NumPy: logistic loss, binned features, trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Full binary trees in arrays: node i has children 2i + 1 (value at most the bound) and 2i + 2."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: int = 8):
        self.n, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.bounds = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(self.bounds, x.T, strict=True)], 1)
        width = self.bins
        flat = binned + np.arange(m) * width
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.n, inner), np.int64)
        self.bound = np.full((self.n, inner), np.inf)
        self.leaf = np.zeros((self.n, leaves))
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                local = at - first
                cells = (local[:, None] * (m * width) + flat).ravel()
                size = nodes * m * width
                sums = [np.bincount(cells, np.repeat(w, m), size).reshape(nodes, m, width).cumsum(2) for w in (g, h, np.ones(n))]
                total = [s[:, :, -1:] for s in sums]
                gain = sum((s**2 / (k + self.ridge)) for s, k in ((sums[0], sums[1]), (total[0] - sums[0], total[1] - sums[1]))) - total[0] ** 2 / (total[1] + self.ridge)
                gain[(sums[2] < self.least) | (total[2] - sums[2] < self.least)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                for k in range(nodes):
                    f, b = divmod(int(best[k]), width)
                    if gain[k, f, b] > 1e-6 and b < len(self.bounds[f]):
                        self.feature[t, first + k], self.bound[t, first + k] = f, self.bounds[f][b]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.bound[t, at])
            leaf = at - inner
            up, low = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            self.leaf[t] = self.rate * up / (low + self.ridge)
            score += self.leaf[t, leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = 2**self.depth - 1
        for t in range(self.n):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.bound[t, at])
            score += self.leaf[t, at - inner]
        return score
