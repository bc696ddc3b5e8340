"""Gradient-boosted decision trees for two classes, small enough to be sent to every task."""

from __future__ import annotations

import numpy as np

_BINS = 32


class BoostedTrees:
    """Trees of a fixed depth on binned features, fitted to the gradient of the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self._stacked: tuple | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaves(tree, x)
        return self

    def _grow(self, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        value = np.zeros(2**self.depth)
        node = np.zeros(len(gradient), int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, None, None)
            if len(rows) >= 2 * self.least:
                g, h = gradient[rows], weight[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = bins[rows, j]
                    gs, hs, ns = (np.bincount(b, w, minlength=len(e) + 1)[:-1].cumsum() for w in (g, h, np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            right = np.zeros(len(rows), int)
            if best[1] is not None:
                feature[at], cut[at] = best[1], edges[best[1]][best[2]]
                right = (bins[rows, best[1]] > best[2]).astype(int)
            node[rows] = 2 * at + 1 + right
        for leaf in range(2**self.depth):
            rows = node == inner + leaf
            value[leaf] = self.rate * gradient[rows].sum() / (weight[rows].sum() + 1)
        return feature, cut, value

    def _leaves(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class. All trees are followed at once."""
        if not self.trees or not len(x):
            return np.full(len(x), self.base)
        if self._stacked is None:
            self._stacked = tuple(np.stack(part) for part in zip(*self.trees))
        feature, cut, value = self._stacked
        trees, rows = np.arange(len(self.trees))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.trees), len(x)), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[trees, node]] > cut[trees, node])
        return self.base + value[trees, node - feature.shape[1]].sum(axis=0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
