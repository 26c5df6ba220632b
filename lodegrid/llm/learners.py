"""Small learners in numpy for the classifiers of this subpackage. All are deterministic."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Gradient-boosted regression trees for the logistic loss, on histograms of quantile bins."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, ridge: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.concatenate([np.quantile(c, quantiles), [c.min(), np.median(c[c > c.min()]) if (c > c.min()).any() else c.min()]])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        width = max(len(e) for e in edges) + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        columns = np.arange(f) * width
        for _ in range(self.rounds):
            p = sigmoid(margin)
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            tree: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(self.depth):
                nodes = 1 << level
                flat = (node[:, None] * (f * width) + columns[None] + binned).ravel()
                size = nodes * f * width
                g, h, c = (np.bincount(flat, np.repeat(v, f), size).reshape(nodes, f, width).cumsum(axis=2) for v in (grad, hess, np.ones(n)))
                total_g, total_h, total_c = (v[:, :, -1:] for v in (g, h, c))
                gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(c < self.least) | (total_c - c < self.least)] = -1
                best = gain.reshape(nodes, -1).argmax(axis=1)
                useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                column, cut = best // width, best % width
                threshold = np.array([edges[j][b] if u and b < len(edges[j]) else np.inf for j, b, u in zip(column, cut, useful, strict=True)])
                tree.append((column, threshold))
                node = 2 * node + (x[np.arange(n), column[node]] > threshold[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            self.trees.append((tree, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for column, threshold in tree:
                node = 2 * node + (x[rows, column[node]] > threshold[node])
            out += value[node]
        return out


class Isotonic:
    """Isotonic regression by pooling adjacent violators, linear between the pools. A thousandth of the
    score follows the margin itself, so equal pools keep their order."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum of y, sum of margins, size
        for m, v in zip(margin[order], y[order], strict=True):
            pools.append([float(v), float(m), 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[1] / p[2] for p in pools])
        self.y = np.array([(p[0] + 0.05) / (p[2] + 0.1) for p in pools])
        self.y = np.maximum.accumulate(self.y)
        return self

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(margin, self.x, self.y) + 0.001 * sigmoid(margin)


def folds(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % k


def calibrated_trees(x: np.ndarray, y: np.ndarray, k: int = 5) -> tuple[BoostedTrees, Isotonic]:
    """Trees on all rows, calibrated on out-of-fold margins."""
    fold, margin = folds(len(y), k, 3), np.zeros(len(y))
    for i in range(k):
        held = fold == i
        if held.any() and not held.all():
            margin[held] = BoostedTrees().fit(x[~held], y[~held]).margin(x[held])
    return BoostedTrees().fit(x, y), Isotonic().fit(margin, y)


class Positives:
    """Positive-unlabelled learning by the non-negative unbiased risk (a network of one hidden layer).

    With p the class prior, the risk is p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]), loss
    the logistic one. Where the bracket is negative, its gradient is climbed instead.
    """

    def __init__(self, hidden: int = 16, steps: int = 600, rate: float = 0.02, decay: float = 1e-4):
        self.hidden, self.steps, self.rate, self.decay = hidden, steps, rate, decay

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.weights
        h = np.tanh(x @ w + b)
        return h, h @ v + c

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Positives:
        rng = np.random.default_rng(5)
        f = positive.shape[1]
        self.weights = [rng.normal(0, 1 / np.sqrt(f), (f, self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), 0.0]
        x = np.concatenate([positive, unlabelled])
        n, m = len(positive), len(unlabelled)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for step in range(1, self.steps + 1):
            h, g = self._forward(x)
            p = sigmoid(g)
            loss = np.logaddexp(0, g)  # of a negative label
            bracket = loss[n:].mean() - prior * loss[:n].mean()
            d = np.empty(n + m)
            if bracket >= 0:
                d[:n] = (prior * (p[:n] - 1) - prior * p[:n]) / n
                d[n:] = p[n:] / m
            else:
                d[:n] = prior * p[:n] / n
                d[n:] = -p[n:] / m
            dh = np.outer(d, self.weights[2]) * (1 - h**2)
            grads = [x.T @ dh + self.decay * self.weights[0], dh.sum(axis=0), h.T @ d + self.decay * self.weights[2], d.sum()]
            for i, gr in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr**2
                self.weights[i] = self.weights[i] - self.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled sample: the least ratio of the two samples' tails.

    A logistic model tells the samples apart out of fold. As unlabelled = p * positive + rest, for any
    set of scores its share among the unlabelled is at least p times its share among the positives; the
    tails of likely positives come closest. Both shares are taken with a margin of one standard error.
    """
    x = np.concatenate([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    fold, score = folds(len(y), 3, 4), np.zeros(len(y))
    for i in range(3):
        held = fold == i
        score[held] = BoostedTrees(rounds=40, depth=2).fit(x[~held], y[~held]).margin(x[held])
    p, u = np.sort(score[y == 1]), np.sort(score[y == 0])
    best = 1.0
    for t in np.quantile(p, np.linspace(0.0, 0.8, 41)):
        a = 1 - np.searchsorted(p, t) / len(p)
        b = 1 - np.searchsorted(u, t) / len(u)
        best = min(best, (b + np.sqrt(b * (1 - b) / len(u))) / max(1e-9, a - np.sqrt(a * (1 - a) / len(p))))
    return float(np.clip(best, 0.02, 0.98))
