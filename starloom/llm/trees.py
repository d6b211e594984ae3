"""Gradient-boosted decision trees on a bounded table of training rows, by histograms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: per inner node a feature and a limit, per leaf a value."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    limit: np.ndarray
    leaf: np.ndarray     # (trees, 2^depth)
    start: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > limit[at])
            out += leaf[at - inner] if len(at) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, weight: float = 1.0) -> Trees:
    """Trees for 0/1 labels y. Each level of a tree takes, in each node, the split with the greatest gain."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = y.mean().clip(1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    score = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            here = at - first
            best, where = np.full(nodes, 1e-6), np.full((nodes, 2), -1)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                slot, size = here * bins + binned[:, f], nodes * bins
                gs = np.bincount(slot, weights=g, minlength=size).reshape(nodes, bins)
                hs = np.bincount(slot, weights=h, minlength=size).reshape(nodes, bins)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + weight) + (gt - gl) ** 2 / (ht - hl + weight) - gt**2 / (ht + weight)
                k = gain[:, : len(cuts[f])].argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better] = top[better]
                where[better, 0], where[better, 1] = f, k[better]
            for node in range(nodes):
                f, k = where[node]
                if f >= 0:
                    feature[t, first + node], limit[t, first + node] = f, cuts[f][k]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > limit[t][at])
        ends = at - inner
        leaf[t] = rate * np.bincount(ends, weights=g, minlength=leaves) / (np.bincount(ends, weights=h, minlength=leaves) + weight)
        score += leaf[t][ends]
    return Trees(feature, limit, leaf, start)
