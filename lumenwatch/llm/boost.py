"""Gradient-boosted trees: logistic loss, binned features, trees of fixed depth, grown from sums over all rows.

A level of a tree needs the sums of gradients and curvatures by node, feature and bin alone, so rows may lie
anywhere: Part gives the sums of some rows, and sums of several parts add up. They are whole numbers (steps of
1 / ONE), so the trees don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Steps of a gradient, and the largest value of a feature in Part.
ONE, TOP = 1 << 22, 255


class Part:
    """Rows with features of 0 to TOP: x (bytes), y, base, held out or not, and how often each occurs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, base: np.ndarray, held: np.ndarray, n: np.ndarray):
        self.x, self.y, self.base, self.held, self.n = x, y, base, held, n
        self.score, self.done, self.bins = None, 0, None

    def total(self, f: Callable[[Part], np.ndarray]) -> np.ndarray:
        return f(self)

    def values(self) -> np.ndarray:
        """Training rows by feature and value."""
        n = np.where(self.held, 0, self.n)
        return np.stack([np.bincount(self.x[:, j], n, TOP + 1) for j in range(self.x.shape[1])]).astype(np.int64) if self.x.shape[1] else np.zeros((0, TOP + 1), np.int64)

    def sums(self, model: BoostedTrees, tree: tuple[np.ndarray, np.ndarray], level: int) -> np.ndarray:
        """Gradients and curvatures of training rows by node of the level, feature and bin."""
        if self.score is None:
            self.bins, self.score = model.binned(self.x), np.full(len(self.y), model.start)
        for features, _, places, values in model.trees[self.done :]:
            self.score = self.score + values[descend(self.bins, features, places, model.depth)]
        self.done = len(model.trees)
        p, n, nodes = 1 / (1 + np.exp(-self.score)), np.where(self.held, 0, self.n), 1 << level
        weights = [np.rint(w * ONE) * n for w in (self.y - p, np.maximum(p * (1 - p), 1e-6))]
        key = descend(self.bins, *tree, level) * model.bins
        return np.array([[np.bincount(key + self.bins[:, j], w, nodes * model.bins) for j in range(self.bins.shape[1])] for w in weights]).astype(np.int64).reshape(2, -1, nodes, model.bins)


def descend(bins: np.ndarray, features: np.ndarray, places: np.ndarray, levels: int) -> np.ndarray:
    node, each = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        at = (1 << level) - 1 + node
        node = node * 2 + (bins[each, features[at]] > places[at])
    return node


def quantiles(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """np.quantile of the ascending values, each as often as counted."""
    ends = np.cumsum(counts)
    place = at * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, f(place), side="right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (place - np.floor(place))


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.cuts = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Trees of rows with any numbers as features."""
        part = Part(x, y, np.zeros(len(y), bool), np.zeros(len(y), bool), np.ones(len(y), np.int64))
        return self.begin([np.unique(x[:, j], return_counts=True) for j in range(x.shape[1])], float(y.mean())).grow(part.total)

    def begin(self, counted: list[tuple[np.ndarray, np.ndarray]], mean: float) -> BoostedTrees:
        """Cuts of each feature from its values and their counts, and the score without any tree."""
        mean = float(np.clip(mean, 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(quantiles(v, n, at)) for v, n in counted]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def grow(self, total: Callable[[Callable[[Part], np.ndarray]], np.ndarray]) -> BoostedTrees:
        """The trees; total adds up what a function gives of each part of the rows."""
        for _ in range(self.rounds):
            features, thresholds, places = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf), np.full(2**self.depth - 1, self.bins)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                tree = features.copy(), places.copy()
                sums = total(lambda part: part.sums(self, tree, level)) / ONE  # noqa: B023
                best, left = np.zeros(n), sums[:, 0].sum(2)  # no split: all go left
                whole = left
                for j, c in enumerate(self.cuts):
                    if not len(c):
                        continue
                    (gl, hl), (gt, ht) = sums[:, j].cumsum(2)[:, :, : len(c)], whole[:, :, None]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(1)
                    value = gain[np.arange(n), at]
                    better = value > best + 1e-9
                    best = np.where(better, value, best)
                    left = np.where(better, np.stack([gl, hl])[:, np.arange(n), at], left)
                    for a, v in ((features, j), (thresholds, c[at]), (places, at)):
                        a[first : first + n] = np.where(better, v, a[first : first + n])
            g, h = np.stack([left, whole - left], 2).reshape(2, -1)
            self.trees.append((features, thresholds, places, self.rate * g / (h + self.ridge)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for features, thresholds, _, values in self.trees:
            out += values[descend(x, features, thresholds, self.depth)]
        return out
