"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees side by side. A leaf's children are itself, so all rows may walk depth steps."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of x."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss. With one class alone, a forest without trees that gives its share (kept off 0 and 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = _edges(x, bins)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        total = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            todo = [(np.arange(len(y)), 0, None, None)]
            while todo:
                rows, level, parent, side = todo.pop()
                node = len(feature)
                if parent is not None:
                    side[parent] = node
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, j]
                        n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                        gain[(n < least) | (len(rows) - n < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], (j, k))
                feature.append(0)
                cut.append(0.0)
                left.append(node)
                right.append(node)
                value.append(float(rate * g / (h + penalty)))
                if best[1] is None:
                    total[rows] += value[node]
                    continue
                j, k = best[1]
                feature[node], cut[node] = j, float(edges[j][k])
                low = binned[rows, j] <= k
                todo.append((rows[~low], level + 1, node, right))
                todo.append((rows[low], level + 1, node, left))
    whole = lambda v: np.array(v, np.int64)
    return Forest(whole(feature), np.array(cut, float), whole(left), whole(right), np.array(value, float), whole(roots), depth, start)
