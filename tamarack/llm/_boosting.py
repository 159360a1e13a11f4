"""Gradient boosting of depth-two trees, small enough to become a Column.

Training is NumPy over distinct feature rows with counts; a model is a
list of trees, which ``as_column`` turns into nested CASE expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[int, ...]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, threshold) of the best split of rows with gradients and weights."""
    best = None
    fit = lambda g, h: g * g / (h + 1.0)
    for f in range(x.shape[1] if len(x) else 0):
        low = x[:, f].min()
        sums = [np.cumsum(np.bincount(x[:, f] - low, weights=w)) for w in (g, h)]
        here, there = (fit(s[0], s[1]) for s in (sums, [s[-1] - s for s in sums]))
        gain = (here + there - fit(sums[0][-1], sums[1][-1]))[:-1]
        if len(gain) and (best is None or gain.max() > best[0] + 1e-12):
            best = (float(gain.max()), f, int(low + gain.argmax()))
    return best if best and best[0] > 1e-6 else None


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    cut = _split(x, g, h) if depth else None
    if cut is None:
        return float(rate * g.sum() / (h.sum() + 1.0))
    _, f, at = cut
    left = x[:, f] <= at
    return (f, at, _tree(x[left], g[left], h[left], depth - 1, rate), _tree(x[~left], g[~left], h[~left], depth - 1, rate))


def value(tree, x: Row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: dict[Row, tuple[int, int]], rounds: int = 24, depth: int = 2, rate: float = 0.4) -> list:
    """Trees for log-odds of the second class; ``counts``: (negatives, positives) of each row."""
    trees: list = []
    if not counts:
        return trees
    rows = sorted(counts)
    x, n = np.array(rows, dtype=np.int64), np.array([counts[r] for r in rows], dtype=np.float64)
    score = np.zeros(len(rows))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, n[:, 1] - n.sum(1) * p, n.sum(1) * p * (1 - p), depth, rate)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score += [value(tree, r) for r in rows]
    return trees


def as_column(trees: list, features: list[Column]) -> Column:
    def one(tree) -> Column:
        return F.when(features[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    total = F.lit(0.0)
    for t in trees:
        total = total + one(t)
    return total
