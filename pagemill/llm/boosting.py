"""Gradient-boosted trees for a few numeric features; fitted on the driver on bounded samples, applied in batches."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Logistic boosting of shallow histogram trees."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, least: int = 4):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.forest = -9.0, []  # nothing, until it is fitted

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._tree(codes, edges, y - p, p * (1 - p))
            self.forest.append(tree)
            score += step
        return self

    def _tree(self, codes, edges, gradient, hessian):
        nodes: list[tuple] = []
        step = np.zeros(len(gradient))

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append(())
            g, h = gradient[rows].sum(), hessian[rows].sum()
            best = (1e-6, -1, -1)
            if level < self.depth and len(rows) >= 2 * self.least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                    k = int(np.argmax(gain))
                    best = max(best, (float(gain[k]), f, k))
            if best[1] < 0:
                value = self.rate * g / (h + 1)
                step[rows] = value
                nodes[at] = (-1, 0.0, value, 0)
                return at
            _, f, k = best
            left = codes[rows, f] <= k
            low = grow(rows[left], level + 1)
            high = grow(rows[~left], level + 1)
            nodes[at] = (f, float(edges[f][k]), low, high)
            return at

        grow(np.arange(len(gradient)), 0)
        return nodes, step

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        score = np.full(len(x), self.base)
        for nodes in self.forest:
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                f, cut, low, high = nodes[at]
                if f < 0:
                    score[rows] += low
                else:
                    left = x[rows, f] <= cut
                    todo += [(low, rows[left]), (high, rows[~left])]
        return 1 / (1 + np.exp(-score))

    def one(self, x) -> float:
        """The probability of one row of features, without arrays."""
        score = self.base
        for nodes in self.forest:
            at = 0
            while nodes[at][0] >= 0:
                f, cut, low, high = nodes[at]
                at = low if x[f] <= cut else high
            score += nodes[at][2]
        return 1 / (1 + math.exp(-score))
