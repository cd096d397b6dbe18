"""Gradient-boosted trees over counted cells of binned features, scored as one SQL expression.

Training takes a row per distinct combination of feature values and its numbers of positive and negative cases, so its input is bounded by
the bins, whatever the corpus holds, and covers every case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as nested tuples (feature, threshold, low, high), leaves as floats; ``a`` and ``b`` calibrate the sum to a log-odds."""

    trees: list
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if isinstance(tree, float):
                return np.full(len(rows), tree)
            f, t, low, high = tree
            left = x[rows, f] <= t
            out = np.empty(len(rows))
            out[left], out[~left] = walk(low, rows[left]), walk(high, rows[~left])
            return out

        return sum((walk(t, np.arange(len(x))) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -30, 30)))

    def sql(self, features: list[str]) -> str:
        """The calibrated probability as an expression on feature columns."""

        def case(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            f, t, low, high = tree
            return f"CASE WHEN {features[f]} <= {t} THEN {case(low)} ELSE {case(high)} END"

        total = " + ".join(case(t) for t in self.trees) or "0D"
        return f"1D / (1D + exp(-({self.a!r}D * ({total}) + {self.b!r}D)))"


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; a split must gain something, and ties go to the first feature and lowest threshold."""
    f = np.zeros(len(x))
    n = pos + neg
    trees = []

    def grow(rows, g, h, left):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(rate * total_g / (total_h + ridge))
        best = None
        if left:
            for k in range(x.shape[1]):
                for t in np.unique(x[rows, k])[:-1]:
                    low = x[rows, k] <= t
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, k, int(t), low)
        if best is None:
            return leaf
        _, k, t, low = best
        return (k, t, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(x)), pos - n * p, n * p * (1 - p), depth)
        trees.append(tree)
        f = f + Boosted([tree]).raw(x)
    return Boosted(trees)


def calibrate(model: Boosted, x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> Boosted:
    """Platt scaling on other cells than those that the trees were grown on, with smoothed targets."""
    s = model.raw(x)
    n_pos, n_neg = pos.sum(), neg.sum()
    up, down = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r = pos * (up - p) + neg * (down - p)
        w = (pos + neg) * p * (1 - p) + 1e-9
        ga, gb = (r * s).sum() - 1e-3 * (a - 1), r.sum()
        haa, hab, hbb = (w * s * s).sum() + 1e-3, (w * s).sum(), w.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2 / max(1e-9, math.hypot(da, db)))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return Boosted(model.trees, float(max(a, 1e-3)), float(b))


def threshold(model: Boosted, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float) -> float | None:
    """Calibrated score from which on held-out precision, with one added miss, is at least ``precision``, and one half at least; None if there is none.

    Scores are taken from the highest down, and one with more misses than hits among its own held-out cases ends that, so that many easy cases above it
    don't pay for it. The threshold lies in the middle between the lowest score that passes and the next that doesn't.
    """
    p = model.probability(x)
    found, below = None, 0.0
    for t in np.unique(p)[::-1]:
        at = p >= t
        if neg[p == t].sum() <= pos[p == t].sum() and pos[at].sum() / (pos[at].sum() + neg[at].sum() + 1) >= precision:
            found, below = float(t), 0.0
            continue
        below = below or float(t)
        if neg[p == t].sum() > pos[p == t].sum():
            break
    return None if found is None else max(0.5, (found + below) / 2)
