"""Gradient-boosted regression trees for a logistic loss, small enough to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    start: float
    rate: float
    feature: np.ndarray  # tree, inner node (a full tree: the children of n are 2n+1 and 2n+2)
    cut: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), "i8")
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            out += self.rate * v[node - (len(c))]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting over quantile cuts; ties go to the first feature and the lowest cut."""
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin > k means x > cut k
    score = np.full(len(y), start)
    inner = (1 << depth) - 1
    features, edges, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, edge = np.zeros(inner, "i8"), np.full(inner, np.inf)
        node = np.zeros(len(y), "i8")
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = (1e-9, 0, np.inf, 0)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            base = total_g**2 / (total_h + ridge)
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - base
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float(c[k]), k)
            _, j, edge[n], k = best
            feature[n] = j
            right = (binned[rows, j] > k) if np.isfinite(edge[n]) else np.zeros(len(rows), bool)
            node[rows] = 2 * n + 1 + right
        last = node - inner
        sum_g, sum_h = np.bincount(last, g, inner + 1), np.bincount(last, h, inner + 1)
        leaf = sum_g / (sum_h + ridge)
        score += rate * leaf[last]
        features.append(feature)
        edges.append(edge)
        leaves.append(leaf)
    return Trees(start, rate, np.array(features), np.array(edges), np.array(leaves))


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on, at every higher threshold too, the share of true rows is at least precision (inf if none)."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    ends = np.append(np.flatnonzero(s[1:] < s[:-1]), len(s) - 1) if len(s) else np.zeros(0, "i8")
    good = hit[ends] / (ends + 1) >= precision
    stop = len(good) if good.all() else int(good.argmin())
    return float(s[ends[stop - 1]]) if stop else float("inf")
