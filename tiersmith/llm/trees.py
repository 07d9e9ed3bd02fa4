"""Gradient-boosted trees and isotonic calibration on a bounded table of dense features.

Small, since the table is: the caller bounds its rows. Trees are of one depth
and kept as arrays, so that a worker scores a batch without a Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Sum of trees over binned features. Tree t splits node i of a level by ``feature[t][i] > threshold[t][i]``."""

    base: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)  # heap order, root 0
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with second-order splits on quantile bins; the same input gives the same trees."""
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(mean / (1 - mean))))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + BINS * np.arange(m)[None, :]
    margin = np.full(n, model.base)
    n_inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first) * (m * BINS))[:, None] + flat
            size = width * m * BINS
            g = np.bincount(slot.ravel(), np.repeat(grad, m), size).reshape(width, m, BINS).cumsum(2)
            h = np.bincount(slot.ravel(), np.repeat(hess, m), size).reshape(width, m, BINS).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
            for node in range(width):
                j, b = divmod(int(gain[node].argmax()), BINS)
                if gain[node, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + node], threshold[first + node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_at = at - n_inner
        g, h = (np.bincount(leaf_at, v, n_inner + 1) for v in (grad, hess))
        leaf = -rate * g / (h + ridge)
        margin += leaf[leaf_at]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(leaf)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve from scores to the share of ones: pooled adjacent violators, joined by lines.

    Rows of equal score are one point from the start, so the curve does not depend on the order of rows.
    """
    points, place, rows = np.unique(score, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of scores, sum of y, rows
    for s, v, n in zip(points, np.bincount(place, y, len(points)), rows, strict=True):
        blocks.append([float(s * n), float(v), float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
