"""Gradient-boosted regression trees for two classes, on histograms, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Complete trees of one depth, fitted to the logistic loss by Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, penalty: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.penalty, self.least = rounds, depth, rate, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.threshold = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, inner + 1))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.zeros(many)
                cut = np.zeros(many, np.int64)
                local = at - first
                for f in range(width):
                    cell = local * BINS + binned[:, f]
                    gs = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(1)
                    hs = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain = gain[:, : len(self.cuts[f])]
                    if gain.shape[1]:
                        k = gain.argmax(1)
                        top = gain[np.arange(many), k]
                        for i in np.flatnonzero(top > best + 1e-9):
                            best[i], cut[i] = top[i], k[i]
                            self.feature[t, first + i], self.threshold[t, first + i] = f, self.cuts[f][k[i]]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.threshold[t, at])
            leaf = at - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.value[t] = -self.rate * gs / (hs + self.penalty)
            margin += self.value[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.rounds):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            out += self.value[t][at - 2**self.depth + 1]
        return out
