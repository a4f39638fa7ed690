"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete binary trees of one depth: node i of a tree has children 2i + 1 and 2i + 2; a row goes
    right where its feature exceeds the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def scores(self, rows: np.ndarray, step: int = 4096) -> np.ndarray:
        """Probability of class 1 for each row; all trees and rows descend a level at once."""
        out = np.full(len(rows), self.base)
        trees, inner = self.feature.shape
        if trees:
            tree = np.arange(trees)[None, :]
            depth = (inner + 1).bit_length() - 1
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                at = np.zeros((len(part), trees), np.int64)
                row = np.arange(len(part))[:, None]
                for _ in range(depth):
                    right = part[row, self.feature[tree, at]] > self.threshold[tree, at]
                    at = 2 * at + 1 + right
                out[i : i + step] += self.leaf[tree, at - inner].sum(1)
        return 1.0 / (1.0 + np.exp(-out))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 150,
    depth: int = 4,
    rate: float = 0.08,
    bins: int = 64,
    l2: float = 1.0,
    least_rows: int = 20,
) -> FlatTrees:
    """Logistic loss, second order, level by level; the same rows always give the same trees. Without
    rows the score is 1/2, with one class only it is that class's smoothed share."""
    n, width = rows.shape
    inner = (1 << depth) - 1
    p = (labels.sum() + 1.0) / (n + 2.0)
    base = float(np.log(p / (1 - p)))
    if n == 0 or labels.min() == labels.max():
        return FlatTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], 1)
    raw = np.full(n, base)
    features = np.zeros((trees, inner), np.int64)
    thresholds = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        score = 1.0 / (1.0 + np.exp(-raw))
        g, h = labels - score, score * (1 - score)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.full(nodes, 1e-6)
            choice = np.full((nodes, 2), -1)
            for f in range(width):
                slot = (at - first) * bins + binned[:, f]
                hist = [np.bincount(slot, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, None)]
                gl, hl, nl = hist
                gt, ht, nt = (x[:, -1:] for x in hist)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least_rows) | (nt - nl < least_rows)] = 0
                where = gain.argmax(1)
                top = gain[np.arange(nodes), where]
                better = top > best + 1e-9
                best[better] = top[better]
                choice[better] = np.stack([np.full(nodes, f), where], 1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                f, b = choice[k]
                if b < len(cuts[f]):
                    features[t, first + k], thresholds[t, first + k] = f, cuts[f][b]
            node = at
            right = rows[np.arange(n), features[t, node]] > thresholds[t, node]
            at = 2 * node + 1 + right
        leaf = at - inner
        top, bottom = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves[t] = rate * top / (bottom + l2)
        raw += leaves[t, leaf]
    return FlatTrees(base, features, thresholds, leaves)
