"""A small gradient-boosting classifier for binary labels, on the driver and on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features under the logistic loss, with Newton leaves.

    Fits are deterministic: no rows or columns are drawn at random.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, values = self._tree(binned, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            score += values
        return self

    def _tree(self, binned, cuts, grad, hess):
        """Arrays of (feature, cut, value) over a full binary tree; feature -1 passes left."""
        inner = 2**self.depth - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(inner + 1)
        node = np.zeros(len(grad), dtype=np.int64)
        for level in range(self.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.nonzero(node == k)[0]
                best = (1e-6, -1, 0)
                if len(mine):
                    g, h = grad[mine], hess[mine]
                    whole = g.sum() ** 2 / (h.sum() + self.least)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[mine, j]
                        gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.least) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.least) - whole
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], j, at)
                right = np.zeros(len(mine), dtype=bool)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                    right = binned[mine, best[1]] > best[2]
                node[mine] = 2 * k + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = self.rate * g / (h + self.least)
        return (feature, cut, value), value[leaf]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))
