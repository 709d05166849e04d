"""A random forest of Gini trees over numeric features, small enough to be sent to every task."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, trees: int = 24, depth: int = 7, leaf: int = 4, seed: int = 7):
        self.n_trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list] = []
            self._grow(x[rows], y[rows].astype(float), 0, rng, nodes)
            feature, cut, left, right, p = zip(*nodes, strict=True)
            self.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(p)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list[list]) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in rng.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1])))]:
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (len(y) - k >= self.leaf)
            if not ok.any():
                continue
            a, b = s[:-1] / k, (s[-1] - s[:-1]) / (len(y) - k)
            gain = np.where(ok, whole - (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y), -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), int(f), float((v[j] + v[j + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            left = self._grow(x[go], y[go], depth + 1, rng, nodes)
            right = self._grow(x[~go], y[~go], depth + 1, rng, nodes)
            nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of label 1 in each row's leaf."""
        out = np.zeros(len(x))
        for feature, cut, left, right, p in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += p[at]
        return out / max(1, len(self.trees))
