"""Histogram gradient-boosted trees for two classes in numpy, flattened into arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself. Node i of tree t starts at roots[t]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of x: all trees step down together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Up to bins - 1 cuts for each feature, halfway between neighbouring quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boosts trees on the logistic loss. A table of one class or no rows gives a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Forest(none, none.astype(float), none, none, none.astype(float), none, 0, base)
    edges = bin_edges(x, bins)
    n, width = x.shape
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for step in range(depth + 1):
            below = []
            for k, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[k] = -rate * g / (h + ridge)
                found = None if step == depth or len(rows) < 2 * least else _split(flat[rows], grad[rows], hess[rows], width, bins, ridge, least)
                if found is None:
                    margin[rows] += value[k]
                    continue
                f, b = found
                goes = binned[rows, f] <= b
                feature[k], threshold[k], left[k], right[k] = f, edges[f][b], node(), node()
                below += [(left[k], rows[goes]), (right[k], rows[~goes])]
            level = below
    return Forest(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth, base)


def _split(flat, grad, hess, width, bins, ridge, least):
    """The feature and bin with the largest gain, from histograms of gradients; None if nothing is gained."""
    at = flat.ravel()
    g = np.bincount(at, np.repeat(grad, width), width * bins).reshape(width, bins).cumsum(1)
    h = np.bincount(at, np.repeat(hess, width), width * bins).reshape(width, bins).cumsum(1)
    n = np.bincount(at, minlength=width * bins).reshape(width, bins).cumsum(1)
    gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
    gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
    gain[(n < least) | (nt - n < least)] = 0
    gain[:, -1] = 0
    f, b = divmod(int(gain.argmax()), bins)
    return (f, b) if gain[f, b] > 1e-6 else None
