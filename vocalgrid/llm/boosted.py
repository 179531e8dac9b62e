"""Boosted regression trees for two classes in numpy: histogram splits, second-order gains, calibrated scores."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of one depth over binned features; ``score`` gives a calibrated probability."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: float = 4.0) -> None:
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bin of each inner node, values of the leaves
        self.base = 0.0
        self.steps_at, self.steps_to = np.zeros(0), np.zeros(0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [self._edges(x[:, k]) for k in range(x.shape[1])]
        bins = self._binned(x)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]

    @staticmethod
    def _edges(values: np.ndarray) -> np.ndarray:
        kinds = np.unique(values)
        if len(kinds) > BINS:
            kinds = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)))
        return (kinds[1:] + kinds[:-1]) / 2

    def _grow(self, bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
        """One tree, all nodes of a level at once; a node without a gain sends all rows to the left."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(bins), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for k in range(bins.shape[1]):
                place = node * (BINS + 1) + bins[:, k]
                g, h = (np.bincount(place, v, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for v in (gradient, weight))
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(h < self.least / 4) | (all_h - h < self.least / 4)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best
                best[better], feature[first : first + width][better], cut[first : first + width][better] = value[better], k, at[better]
            node = 2 * node + (bins[np.arange(len(bins)), feature[first + node]] > cut[first + node])
        leaves = 2**self.depth
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        return (feature, cut, -self.rate * g / (h + self.ridge)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (bins[rows, feature[at]] > cut[at])
            out += leaves[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Isotonic steps from margin to share of positives, by pooling adjacent violators, on rows not fitted on."""
        order = np.argsort(self.margin(x), kind="stable")
        at = self.margin(x)[order]
        pools: list[list[float]] = []  # sum, count, first margin
        for m, label in zip(at, y[order]):
            pools.append([float(label), 1.0, float(m)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n, _ = pools.pop()
                pools[-1][0] += s
                pools[-1][1] += n
        self.steps_at = np.array([p[2] for p in pools])
        self.steps_to = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(x)
        if not len(self.steps_at):
            return 1 / (1 + np.exp(-margin))
        return self.steps_to[np.maximum(np.searchsorted(self.steps_at, margin, side="right") - 1, 0)]
