"""Gradient-boosted trees over binned dense features with a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of equal depth: for each level a feature and a threshold per node, then leaf values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            inner = len(feature)
            while len(at) and at[0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner] if len(at) else 0.0
        return out


def _bins(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Cut points of each feature: distinct quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        out.append((values[:-1] + values[1:]) / 2 if len(values) <= n else np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1])))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting on histograms. A node that no split improves keeps one with an infinite threshold."""
    n, m = x.shape
    if not n or y.min() == y.max():
        return Boosted(0.0 if not n else float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    cuts = _bins(x, bins)
    width = max(len(c) for c in cuts) + 1
    coded = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    model = Boosted(float(np.log(y.mean() / (1 - y.mean()))))
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-9)
            for f in range(m):
                cell = local * width + coded[:, f]
                gs = np.bincount(cell, weights=g, minlength=nodes * width).reshape(nodes, width).cumsum(1)
                hs = np.bincount(cell, weights=h, minlength=nodes * width).reshape(nodes, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best[better] = gain[np.arange(nodes), k][better]
                feature[first : first + nodes][better] = f
                threshold[first : first + nodes][better] = cuts[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        local = at - inner
        leaf = -rate * np.bincount(local, weights=g, minlength=inner + 1) / (np.bincount(local, weights=h, minlength=inner + 1) + ridge)
        model.trees.append((feature, threshold, leaf))
        margin += leaf[local]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, probabilities) of the monotone fit, to be read by linear interpolation."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    sums, counts = np.add.reduceat(y[order], first), np.diff(np.append(first, len(y)))
    blocks: list[list[float]] = []
    for x, s, c in zip(xs, sums, counts, strict=True):
        blocks.append([s, c, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, _, high = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += c2
            blocks[-1][3] = high
    points = [(x, s / c) for s, c, low, high in blocks for x in ((low, high) if high > low else (low,))]
    return np.array([x for x, _ in points]), np.array([p for _, p in points])
