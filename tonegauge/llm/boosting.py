"""Gradient-boosted trees on a bounded sample of dense rows, and isotonic calibration."""

from __future__ import annotations

import dataclasses

import numpy as np

BINS = 32


@dataclasses.dataclass
class Boosted:
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf; scores are log odds."""

    depth: int
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        flat, width = np.ascontiguousarray(rows).ravel(), rows.shape[1]
        for first in range(0, len(rows), 4096):  # slices that stay in the cache
            row = np.arange(first, min(first + 4096, len(rows))) * width
            for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
                node = np.zeros(len(row), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (flat[row + feature[node]] > cut[node])
                total[first : first + len(row)] += leaf[node - len(feature)]
        return total


def fit(rows: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 3.0) -> Boosted:
    """Second-order boosting of the logistic loss over histograms of at most ``BINS`` bins for each feature, even over its distinct values.

    One class only, or no row: the constant score of that class (0 for no row).
    """
    count = len(rows)
    weight = np.ones(count) if weight is None else weight
    mean = np.clip(np.average(label, weights=weight), 1e-4, 1 - 1e-4) if count else 0.5
    start = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    empty = Boosted(depth, start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not count or label.min() == label.max():
        return empty
    width = rows.shape[1]
    cuts = [_cuts(np.unique(rows[:, f])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * BINS
    score, made = np.full(count, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = weight * (label - p), weight * p * (1 - p)
        node = np.zeros(count, np.int64)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = nodes * width * BINS
            g = np.bincount(place, np.repeat(slope, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            h = np.bincount(place, np.repeat(bend, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least / 10) | (all_h - h < least / 10)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[np.arange(count), feature[node]] > cut[node])
        at = node - inner
        value = rate * np.bincount(at, slope, leaves) / (np.bincount(at, bend, leaves) + ridge)
        score += value[at]
        made.append((feature, cut, value))
    return Boosted(depth, start, *[np.array(part) for part in zip(*made)])


def _cuts(values: np.ndarray) -> np.ndarray:
    """Midpoints between distinct values, at most BINS - 1 of them, evenly by rank."""
    middle = (values[1:] + values[:-1]) / 2
    return middle if len(middle) < BINS else middle[np.linspace(0, len(middle) - 1, BINS - 1).astype(int)]


def isotonic(score: np.ndarray, label: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from scores to probabilities.

    Equal scores are pooled first; every pool's mean is drawn a little to one half, so no probability is 0 or 1. A pool's
    knot stands at the mean of its scores, so that scores between two knots keep their order (centred isotonic
    regression).
    """
    order = np.argsort(score, kind="stable")
    values, first = np.unique(score[order], return_index=True)
    sums, counts = np.add.reduceat(label[order].astype(float), first), np.diff(np.r_[first, len(order)]).astype(float)
    pools: list[list[float]] = []  # sum of scores, labels, rows
    for x, s, n in zip(values, sums, counts):
        pools.append([x * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            high = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], high)]
    x, y = [total / n for total, _, n in pools], [(s + prior / 2) / (n + prior) for _, s, n in pools]
    return np.array(x), np.maximum.accumulate(np.array(y))


def calibrated(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    x, y = knots
    return np.interp(score, x, y) if len(x) else np.full(len(score), 0.5)
