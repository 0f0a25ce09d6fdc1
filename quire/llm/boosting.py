"""Gradient boosted trees for a yes or no, small enough to be fitted on the driver from a bounded sample and to travel with a function.

Features are binned at quantiles, trees are of fixed depth (a complete binary tree, as arrays), each split is chosen by the gain of second-order logistic
boosting.  Equal gains go to the first feature and bin, and rows are put in one order first, so a model depends on nothing but its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Booster:
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a value above it goes right
    value: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (len(value) - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> Booster:
    """A model of y (0 or 1) by x.  A split leaves at least `least` of second-order weight on each side."""
    order = np.lexsort((*x.T, y)) if len(x) else np.arange(0)
    x, y = x[order], y[order].astype(float)
    share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    margin = np.full(len(x), base)
    features, cuts, values = [], [], []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(2**depth - 1):
            own = np.flatnonzero(node == k)
            best = _best_split(bins[own], gradient[own], weight[own], edges, least, ridge)
            if best is not None:
                feature[k], cut[k] = best[0], edges[best[0]][best[1]]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, weight, 2**depth)
        value = rate * g / (h + ridge)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    shape = (len(features), 2**depth - 1)
    return Booster(base, np.array(features, np.int64).reshape(shape), np.array(cuts, float).reshape(shape), np.array(values, float).reshape(len(values), 2**depth))


def _best_split(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray, edges: list[np.ndarray], least: float, ridge: float) -> tuple[int, int] | None:
    total_g, total_h = gradient.sum(), weight.sum()
    best, most = None, 1e-6
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        # bin b has the values in (edge[b - 1], edge[b]]: a cut at edge[b] leaves bins up to b on the left
        g = np.cumsum(np.bincount(bins[:, f], gradient, len(edge) + 1))[:-1]
        h = np.cumsum(np.bincount(bins[:, f], weight, len(edge) + 1))[:-1]
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        gain[(h < least) | (total_h - h < least)] = 0
        at = int(gain.argmax())
        if gain[at] > most:
            best, most = (f, at), gain[at]
    return best
