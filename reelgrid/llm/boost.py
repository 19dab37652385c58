"""Gradient-boosted trees for small labelled tables, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Binary classifier: logistic loss, trees of a fixed depth over a few thresholds per feature."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    least: float = 1.0
    base: float = 0.0
    nodes: list = field(default_factory=list)
    _packed: tuple = ()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, float)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24))) for j in range(x.shape[1])]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.nodes, self._packed = float(np.log(p / (1 - p))), [], ()
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth, cuts)
            self.nodes.append(tree)
            score += self.rate * self._leaf(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth, cuts):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) > 4:
            for j, cs in enumerate(cuts):
                # Sums below every cut at once: rows fall between the cuts, and the sums run on.
                at = np.searchsorted(cs, x[rows, j], "left")
                gl, hl, n = (np.cumsum(np.bincount(at, w, len(cs) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + self.least) + (total_g - gl) ** 2 / (total_h - hl + self.least) - total_g**2 / (total_h + self.least)
                gain = np.where((n > 0) & (n < len(rows)), gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, cs[k])
        if best[1] is None:
            return float(total_g / (total_h + self.least))
        _, j, c = best
        left = x[rows, j] <= c
        return (j, float(c), self._grow(x, g, h, rows[left], depth - 1, cuts), self._grow(x, g, h, rows[~left], depth - 1, cuts))

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._leaf(low, x), self._leaf(high, x))

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All trees as complete ones: features and thresholds of their nodes, and their leaves."""
        if len(self._packed) == 0:
            inner, leaves = 2**self.depth - 1, 2**self.depth
            feature, cut, value = np.zeros((len(self.nodes), inner), np.int64), np.full((len(self.nodes), inner), np.inf), np.zeros((len(self.nodes), leaves))

            def fill(t: int, tree, node: int, level: int) -> None:
                if isinstance(tree, float):
                    first = (node + 1) * 2 ** (self.depth - level) - leaves
                    value[t, first : first + 2 ** (self.depth - level)] = tree
                else:
                    feature[t, node], cut[t, node] = tree[0], tree[1]
                    fill(t, tree[2], 2 * node + 1, level + 1)
                    fill(t, tree[3], 2 * node + 2, level + 1)

            for t, tree in enumerate(self.nodes):
                fill(t, tree, 0, 0)
            self._packed = (feature, cut, value)
        return self._packed

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for each row."""
        x = np.asarray(x, float)
        feature, cut, value = self._flat()
        trees, rows = np.arange(len(self.nodes))[None], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.nodes)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[trees, node]] > cut[trees, node])
        score = self.base + self.rate * value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-score))
