"""Small gradient boosting for logistic loss in numpy: complete trees over quantile thresholds."""

from __future__ import annotations

import numpy as np

#: Where the columns may be split.
QUANTILES = np.linspace(0.05, 0.95, 15)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Boosted:
    """rounds trees of so many levels, each level of a branch split where the loss falls most."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3,
                 weights: np.ndarray | None = None, cuts: list[np.ndarray] | None = None):
        """weights: how many rows a row stands for; cuts: the thresholds of each column, where they are known."""
        self.depth, self.rate, self.trees = depth, rate, []
        w = np.ones(len(x)) if weights is None else weights
        self.cuts = [np.unique(np.quantile(c, QUANTILES)) for c in x.T] if cuts is None else cuts
        mean = float((w * y).sum() / w.sum())
        self.base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        z = np.full(len(x), self.base)
        for _ in range(rounds):
            p = sigmoid(z)
            tree = self._grow(x, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            z += rate * self._leaf(tree, x)

    def _grow(self, x, g, h):
        inner = 2 ** self.depth - 1
        feature, cut, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(x), int)
        for node in range(inner):
            rows = at == node
            best, gain = None, 1e-6
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, cuts in enumerate(self.cuts):
                column = x[rows, f]
                for c in cuts:
                    left = column <= c
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    new = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                    if new > gain:
                        best, gain = (f, c), new
            if best:
                feature[node], cut[node] = best
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for leaf in range(inner + 1):
            rows = at == inner + leaf
            value[leaf] = g[rows].sum() / (h[rows].sum() + 1)
        return feature, cut, value

    def _leaf(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return value[at - (2 ** self.depth - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.base + self.rate * sum(self._leaf(t, x) for t in self.trees)) if len(x) else np.zeros(0)
