"""Small gradient-boosted trees over binary features, learned from a table of feature counts.

Candidates share few feature patterns, so Spark counts the patterns and the trees are fitted on the
counts. A pattern is a whole number whose bits are the features; a fitted model is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 16
RATE = 0.4
_RIDGE = 1.0


@dataclass(frozen=True)
class Boosted:
    """Trees of depth two: (first feature, feature if 0, feature if 1, four leaf values by path)."""

    base: float
    trees: tuple[tuple[int, int, int, tuple[float, float, float, float]], ...]
    threshold: float | None

    def margin(self, pattern: Column) -> Column:
        """Log-odds of a pattern column."""
        bit = lambda f: F.getbit(pattern, F.lit(f)) == 1
        total = F.lit(self.base)
        for first, low, high, leaf in self.trees:
            total = total + F.when(bit(first), F.when(bit(high), leaf[3]).otherwise(leaf[2])).otherwise(
                F.when(bit(low), leaf[1]).otherwise(leaf[0])
            )
        return total


def _leaf(residual: np.ndarray, curvature: np.ndarray) -> float:
    return float(residual.sum() / (curvature.sum() + _RIDGE))


def _gains(bits: np.ndarray, residual: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Gain of a split by each feature."""
    up, weight = residual @ bits, curvature @ bits
    rest, other = residual.sum() - up, curvature.sum() - weight
    return up**2 / (weight + _RIDGE) + rest**2 / (other + _RIDGE)


def fit(patterns: np.ndarray, positive: np.ndarray, total: np.ndarray, features: int) -> tuple[float, list]:
    """Boost ROUNDS trees on the logistic loss of pattern counts."""
    bits = (patterns[:, None] >> np.arange(features)) & 1
    share = (positive.sum() + 0.5) / (total.sum() + 1.0)
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(patterns), base), []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-margin))
        residual, curvature = positive - total * chance, total * chance * (1 - chance)
        first = int(_gains(bits, residual, curvature).argmax())
        sides, leaves = [], []
        for side in (0, 1):
            here = bits[:, first] == side
            split = int(_gains(bits[here], residual[here], curvature[here]).argmax()) if here.any() else first
            sides.append(split)
            for value in (0, 1):
                part = here & (bits[:, split] == value)
                leaves.append(RATE * _leaf(residual[part], curvature[part]))
        trees.append((first, sides[0], sides[1], tuple(leaves)))
        margin = margin + _margins(bits, trees[-1:])
    return base, trees


def _margins(bits: np.ndarray, trees: list) -> np.ndarray:
    total = np.zeros(len(bits))
    for first, low, high, leaf in trees:
        on = bits[:, first] == 1
        total += np.where(on, np.where(bits[:, high] == 1, leaf[3], leaf[2]), np.where(bits[:, low] == 1, leaf[1], leaf[0]))
    return total


def calibrated(
    patterns: np.ndarray, positive: np.ndarray, total: np.ndarray, folds: np.ndarray, features: int,
    precision: float, least: int,
) -> Boosted:
    """Fit on folds other than 0 and lower the threshold from the highest margin until fold 0 first fails.

    It fails where less than ``precision`` of all above is positive, or of one margin that has ``least``
    values or more. The threshold is None, so that nothing is selected, without ``least`` positives above.
    """
    fitted, held = folds != 0, folds == 0
    if not fitted.any() or not held.any():
        return Boosted(0.0, (), None)
    base, trees = fit(patterns[fitted], positive[fitted], total[fitted], features)
    margin = np.round(base + _margins((patterns[held, None] >> np.arange(features)) & 1, trees), 9)
    threshold = None
    for value in np.unique(margin)[::-1]:
        above, level = margin >= value, margin == value
        good, every = positive[held][above].sum(), total[held][above].sum()
        own, size = positive[held][level].sum(), total[held][level].sum()
        if good < precision * every or (size >= least and own < precision * size):
            break
        if good >= least:
            threshold = float(value) - 1e-6
    return Boosted(base, tuple(trees), threshold)
