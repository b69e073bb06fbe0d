"""Gradient-boosted trees on binned features, isotonic calibration and ridge logistic regression, for a bounded sample in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Complete binary trees of one depth; leaves are Newton steps of the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="right") for c, col in zip(self.cuts, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.feature, self.cut, self.leaf = [], [], []
        margin, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.trees):
            p = _sigmoid(margin)
            g, h = y - p, p * (1 - p)
            node, features, cuts = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best, f_best, c_best = np.zeros(n), np.zeros(n, np.int64), np.full(n, width)
                for f in range(x.shape[1]):
                    at = node * width + binned[:, f]
                    gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    c = gain.argmax(1)
                    more = gain[np.arange(n), c] > best + 1e-9
                    best[more], f_best[more], c_best[more] = gain[np.arange(n), c][more], f, c[more]
                features.append(f_best)
                cuts.append(c_best)
                node = 2 * node + (binned[np.arange(len(y)), f_best[node]] > c_best[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            margin += leaf[node]
            self.feature.append(features)
            self.cut.append(cuts)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        binned = np.stack([np.searchsorted(c, col, side="right") for c, col in zip(self.cuts, x.T)], 1)
        rows = np.arange(len(x))
        for features, cuts, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for f, c in zip(features, cuts):
                node = 2 * node + (binned[rows, f[node]] > c[node])
            out += leaf[node]
        return out


class Isotonic:
    """Pool adjacent violators; between the pools' means the calibration is linear."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        value, inverse = np.unique(x, return_inverse=True)
        count = np.bincount(inverse)
        pools = [list(p) for p in zip(value, np.bincount(inverse, y) / count, count)]
        merged: list[list[float]] = []
        for p in pools:
            merged.append(p)
            while len(merged) > 1 and merged[-2][1] >= merged[-1][1]:
                b, a = merged.pop(), merged.pop()
                n = a[2] + b[2]
                merged.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
        self.at, self.value = np.array([p[0] for p in merged]), np.array([p[1] for p in merged])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(25):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weight = w
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(z @ self.weight[:-1] + self.weight[-1])
