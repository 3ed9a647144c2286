"""Small decision trees on a bounded training table, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A condition of a rule: feature, True for "at most the threshold", threshold.
Condition = tuple[str, bool, float]


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    below: Node | None = None
    above: Node | None = None
    path: tuple = field(default_factory=tuple)


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, rng: np.random.Generator, features: int | None = None, bins: int = 48) -> Node:
    """A regression tree on target with weighted squared error; splits at quantile borders."""
    mean = float(np.average(target, weights=weight)) if weight.sum() > 0 else 0.0
    node = Node(mean)
    if depth == 0 or len(x) < 2 * least or np.ptp(target) == 0:
        return node
    chosen = np.arange(x.shape[1]) if features is None else rng.choice(x.shape[1], min(features, x.shape[1]), replace=False)
    best = (1e-12, -1, 0.0)
    wt, total, whole = weight * target, (weight * target).sum(), weight.sum()
    for f in chosen:
        borders = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        if len(borders) == 0:
            continue
        at = np.searchsorted(borders, x[:, f], side="left")
        n = np.cumsum(np.bincount(at, minlength=len(borders) + 1))[:-1]
        w = np.cumsum(np.bincount(at, weight, len(borders) + 1))[:-1]
        s = np.cumsum(np.bincount(at, wt, len(borders) + 1))[:-1]
        ok = (n >= least) & (len(x) - n >= least) & (w > 0) & (whole - w > 0)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / np.where(ok, w, 1) + (total - s) ** 2 / np.where(ok, whole - w, 1) - total**2 / whole, -1)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), int(f), float(borders[i]))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], best[2]
    low = x[:, node.feature] <= node.threshold
    node.below = grow(x[low], target[low], weight[low], depth - 1, least, rng, features, bins)
    node.above = grow(x[~low], target[~low], weight[~low], depth - 1, least, rng, features, bins)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.below is None:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.threshold
    out = np.empty(len(x))
    out[low], out[~low] = predict(node.below, x[low]), predict(node.above, x[~low])
    return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, seed: int = 1) -> list[Node]:
    """Gradient-boosted trees for the logistic loss, each on half of the rows."""
    rng, f, out = np.random.default_rng(seed), np.zeros(len(y)), []
    least = max(2, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = rng.random(len(y)) < 0.5 if len(y) > 100 else np.ones(len(y), bool)
        tree = grow(x[rows], (y - p)[rows], np.ones(rows.sum()), depth, least, rng)
        out.append(tree)
        f += rate * 4 * predict(tree, x)
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, seed: int = 1) -> list[Node]:
    """A random forest: bootstrapped rows, a random subset of the features at every split."""
    rng = np.random.default_rng(seed)
    few = max(1, int(np.sqrt(x.shape[1]) + 1))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(float), np.ones(len(rows)), depth, 2, rng, few))
    return out


def rules(trees: list[Node], names: list[str]) -> list[tuple[Condition, ...]]:
    """Every path from a root to a node, as a conjunction; equal ones once."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node: Node, path: tuple[Condition, ...]) -> None:
        if path:
            bounds: dict[tuple[str, bool], float] = {}
            for name, low, t in path:
                k = (name, low)
                bounds[k] = (min if low else max)(bounds.get(k, t), t)
            found[tuple(sorted((n, low, t) for (n, low), t in bounds.items()))] = None
        if node.below is not None:
            name = names[node.feature]
            walk(node.below, (*path, (name, True, node.threshold)))
            walk(node.above, (*path, (name, False, node.threshold)))

    for tree in trees:
        walk(tree, ())
    return list(found)


def holds(rule: tuple[Condition, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, low, t in rule:
        v = x[:, names.index(name)]
        out &= (v <= t) if low else (v > t)
    return out


def rule_column(rule: tuple[Condition, ...]) -> Column:
    """Parsed from text: a call to the driver's JVM for a rule, not for each of its parts."""
    return F.expr(" AND ".join(f"`{n}` {'<=' if low else '>'} {float(t)!r}D" for n, low, t in rule))


def total(terms: list[Column]) -> Column:
    """The sum as a balanced tree: the planner orders the operands of every sum, which in a chain takes the square of its length."""
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def tree_column(node: Node, names: list[str]) -> Column:
    if node.below is None:
        return F.lit(node.value)
    return F.when(F.col(names[node.feature]) <= F.lit(node.threshold), tree_column(node.below, names)).otherwise(tree_column(node.above, names))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of an L1-penalised logistic regression (accelerated proximal gradient)."""
    n, k = x.shape
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b, w = float(np.log(p / (1 - p))), np.zeros(k)
    v, c, t = w.copy(), b, 1.0
    top = np.ones(k)
    for _ in range(30):  # largest eigenvalue of the design, for the step
        top = x.T @ (x @ top) / n + 1e-12
        size = np.linalg.norm(top)
        top /= size
    step = 1 / (0.25 * (size + 1))
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(x @ v + c))) - y
        w2 = v - step * (x.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w
