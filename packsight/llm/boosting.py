"""Histogram gradient-boosted trees for two classes in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf points at itself, so every row may take ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of features; all trees of a row are walked at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.threshold[node]
            node = self.child[node, right.astype(np.int64)]
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: float = 10.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features; splits need ``least`` rows on either side."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append([len(child)] * 2)
        value.append(0.0)
        return len(feature) - 1

    offset = np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        here = np.full(n, roots[-1])
        open_ = [roots[-1]]
        for _ in range(depth):
            slot = np.full(len(feature), -1)
            slot[open_] = np.arange(len(open_))
            mine = slot[here]
            live = mine >= 0
            cell = (mine[live][:, None] * width * BINS + offset + binned[live]).ravel()
            size = len(open_) * width * BINS
            g, h, c = (np.bincount(cell, np.repeat(v[live], width), size).reshape(-1, width, BINS) for v in (grad, hess, np.ones(n)))
            gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gt, ht, ct = gl[..., -1:], hl[..., -1:], cl[..., -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = -np.inf
            flat = gain.reshape(len(open_), -1)
            best = flat.argmax(axis=1)
            fresh = []
            for i, at in enumerate(open_):
                if not flat[i, best[i]] > 1e-6:
                    continue
                j, b = divmod(int(best[i]), BINS)
                left, right = node(), node()
                feature[at], threshold[at], child[at] = j, float(edges[j][b]), [left, right]
                rows = np.flatnonzero(here == at)
                here[rows] = np.where(binned[rows, j] <= b, left, right)
                fresh += [left, right]
            open_ = fresh
            if not open_:
                break
        leaves = np.unique(here)
        gs, hs = np.bincount(here, grad, len(feature)), np.bincount(here, hess, len(feature))
        for leaf in leaves.tolist():
            value[leaf] = float(-rate * gs[leaf] / (hs[leaf] + ridge))
        raw += np.array(value)[here]
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(child), np.array(value), depth, base)
