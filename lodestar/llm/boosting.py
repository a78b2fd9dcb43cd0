"""Small gradient-boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of one depth for the log-odds of a binary label.

    A tree tests one feature per inner node, kept level by level; a row goes right when its
    feature is above the threshold.
    """

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    shrink: float = 1.0
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(binned, edges, p - y, p * (1 - p))
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """Add one tree and return what it gives to each row."""
        n_features, width = binned.shape[1], self.bins + 1
        node = np.zeros(len(slope), np.int64)
        feature = np.zeros((1 << self.depth) - 1, np.int64)
        threshold = np.full((1 << self.depth) - 1, np.inf)
        for level in range(self.depth):
            count, first = 1 << level, (1 << level) - 1
            gains = np.full((count, n_features, width - 1), -1.0)
            for f in range(n_features):
                cell = node * width + binned[:, f]
                g = np.bincount(cell, slope, count * width).reshape(count, width)
                h = np.bincount(cell, curve, count * width).reshape(count, width)
                left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = (
                    left_g**2 / (left_h + self.shrink) + (all_g - left_g) ** 2 / (all_h - left_h + self.shrink)
                    - all_g**2 / (all_h + self.shrink)
                )
                usable = (np.arange(width - 1) < len(edges[f])) & (left_h > 1e-3) & (all_h - left_h > 1e-3)
                gains[:, f] = np.where(usable, gain, -1.0)
            flat = gains.reshape(count, -1)
            best = flat.argmax(1)
            split = flat[np.arange(count), best] > 1e-9
            cut = np.where(split, best % (width - 1), width)
            feature[first : first + count] = best // (width - 1)
            for k in np.flatnonzero(split):
                threshold[first + k] = edges[best[k] // (width - 1)][cut[k]]
            right = binned[np.arange(len(node)), feature[first + node]] > cut[node]
            node = 2 * node + right
        g = np.bincount(node, slope, 1 << self.depth)
        h = np.bincount(node, curve, 1 << self.depth)
        leaf = -self.rate * g / (h + self.shrink)
        self.features.append(feature)
        self.thresholds.append(threshold)
        self.leaves.append(leaf)
        return leaf[node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > threshold[at])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of y to x by pooling neighbours: points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for at, value in zip(x[order].tolist(), y[order].tolist(), strict=True):
        block = [value, 1.0, at, at]
        while blocks and (blocks[-1][0] >= block[0] or blocks[-1][3] == block[2]):
            mean, weight, first, _ = blocks.pop()
            total = weight + block[1]
            block = [(mean * weight + block[0] * block[1]) / total, total, first, block[3]]
        blocks.append(block)
    points, values = [], []
    for mean, _, first, last in blocks:
        points += [first] if first == last else [first, last]
        values += [mean] if first == last else [mean, mean]
    return np.array(points), np.array(values)
