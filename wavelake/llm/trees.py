"""Small gradient-boosted trees over numpy arrays, and their form as Spark columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 32


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grow(x, codes, cuts, grad, hess, rows, depth, least, ridge):
    value = float(-grad[rows].sum() / (hess[rows].sum() + ridge))
    if depth == 0 or len(rows) < 2 * least:
        return value
    best = (1e-6, None, None)
    g0, h0 = grad[rows].sum(), hess[rows].sum()
    for j, own in enumerate(cuts):
        if not len(own):
            continue
        c = codes[rows, j]
        g = np.bincount(c, grad[rows], len(own) + 1).cumsum()[:-1]
        h = np.bincount(c, hess[rows], len(own) + 1).cumsum()[:-1]
        n = np.bincount(c, minlength=len(own) + 1).cumsum()[:-1]
        gain = g**2 / (h + ridge) + (g0 - g) ** 2 / (h0 - h + ridge) - g0**2 / (h0 + ridge)
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    if best[1] is None:
        return value
    _, j, k = best
    low = codes[rows, j] <= k
    return (j, float(cuts[j][k]), *(_grow(x, codes, cuts, grad, hess, r, depth - 1, least, ridge) for r in (rows[low], rows[~low])))


def fit(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.3, least: int = 10, ridge: float = 1.0) -> tuple[float, list]:
    """(base, trees): a tree is a value, or (feature, threshold, tree up to it, tree above it)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts = []
    for j in range(x.shape[1]):
        points = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)))
        cuts.append((points[:-1] + points[1:]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = sigmoid(z)
        tree = _grow(x, codes, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, least, ridge)
        tree = _scale(tree, rate)
        trees.append(tree)
        z = z + predict(tree, x)
    return base, trees


def _scale(tree, rate):
    return tree * rate if isinstance(tree, float) else (tree[0], tree[1], _scale(tree[2], rate), _scale(tree[3], rate))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, predict(low, x), predict(high, x))


def column(tree, features: list[Column]) -> Column:
    """The tree as one nested CASE WHEN."""
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(features[j] <= F.lit(cut), column(low, features)).otherwise(column(high, features))


def score(model: tuple[float, list], features: list[Column]) -> Column:
    """The model's probability as a column."""
    z = F.lit(model[0])
    for tree in model[1]:
        z = z + column(tree, features)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(tree, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root to a node below it, as a conjunction of (feature, threshold, is it up to the threshold)."""
    if isinstance(tree, float):
        return []
    j, cut, low, high = tree
    out = []
    for branch, up in ((low, True), (high, False)):
        rule = (*so_far, (j, cut, up))
        out += [rule, *paths(branch, rule)]
    return out
