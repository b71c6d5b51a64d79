"""Gradient-boosted trees for two classes, small enough to be sent with a task.

Logistic loss, trees of fixed depth over quantile bins, Newton steps in the leaves, and Platt scaling on rows that the
trees did not see.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    penalty: float = 1.0
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    #: per tree: feature and threshold of each inner node in heap order, and the leaves' values
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.grown.append(tree)
            score += self.rate * self._leaf(tree, x)
        return self

    def _grow(self, x, gradient, weight, cuts):
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for k in range(inner):
            here = node == k
            if not here.any():
                continue
            g, w = gradient[here], weight[here]
            best, whole = 1e-9, g.sum() ** 2 / (w.sum() + self.penalty)
            for j, at in enumerate(cuts):
                if not len(at):
                    continue
                of = np.searchsorted(at, x[here, j], side="right")
                lg = np.cumsum(np.bincount(of, g, len(at) + 1))[:-1]
                lw = np.cumsum(np.bincount(of, w, len(at) + 1))[:-1]
                gain = lg**2 / (lw + self.penalty) + (g.sum() - lg) ** 2 / (w.sum() - lw + self.penalty) - whole
                top = int(gain.argmax())
                if gain[top] > best:
                    best, feature[k], threshold[k] = gain[top], j, at[top]
            node[here] = 2 * k + 1 + (x[here, feature[k]] >= threshold[k])
        leaf = node - inner
        size = inner + 1
        value = np.bincount(leaf, gradient, size) / (np.bincount(leaf, weight, size) + self.penalty)
        return feature, threshold, value

    def _leaf(self, tree, x):
        feature, threshold, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] >= threshold[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._leaf(t, x) for t in self.grown), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
        """Platt scaling: a logistic fit of y on the raw score, with the usual shrunken targets."""
        s = self.raw(x)
        n1, n0 = y.sum(), (1 - y).sum()
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, np.array([((goal - p) * s).sum(), (goal - p).sum()]))
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
