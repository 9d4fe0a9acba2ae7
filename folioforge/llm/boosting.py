"""Gradient-boosted regression trees on binned columns, for bounded samples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Tree(NamedTuple):
    """A complete binary tree: feature, last bin that goes left, and values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(t.value)))):
                at = 2 * at + 1 + (b[rows, t.feature[at]] > t.cut[at])
            out += self.rate * t.value[at - len(t.feature)]
        return out


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.int64) if len(edges) else np.zeros((len(x), 0), np.int64)


def fit_tree(b: np.ndarray, g: np.ndarray, depth: int, least: int, shrink: float) -> Tree:
    """Greedy least-squares splits; nodes too small to split send all rows left."""
    inner = (1 << depth) - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1)
    at = np.zeros(len(g), np.int64)
    for node in range(inner):
        mine = np.flatnonzero(at == node)
        if len(mine) >= 2 * least:
            best = 1e-9
            gs = g[mine]
            total, n = gs.sum(), len(mine)
            for f in range(b.shape[1]):
                s = np.cumsum(np.bincount(b[mine, f], weights=gs, minlength=BINS + 1))[:-1]
                c = np.cumsum(np.bincount(b[mine, f], minlength=BINS + 1))[:-1]
                ok = (c >= least) & (n - c >= least)
                gain = np.where(ok, s * s / (c + shrink) + (total - s) ** 2 / (n - c + shrink) - total * total / (n + shrink), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, k
        at[mine] = 2 * node + 1 + (b[mine, feature[node]] > cut[node])
    leaf = at - inner
    sums = np.bincount(leaf, weights=g, minlength=inner + 1)
    counts = np.bincount(leaf, minlength=inner + 1)
    return Tree(feature, cut, sums / (counts + shrink))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, least: int = 5, clip: float = 4.0) -> Model:
    """Boost on residuals cut at ``clip``, which bounds what a wrong label can do."""
    edges = bin_edges(x)
    b = binned(x, edges)
    base = float(np.median(y))
    pred = np.full(len(y), base)
    grown = []
    least = max(1, min(least, len(y) // 10))
    for _ in range(trees):
        t = fit_tree(b, np.clip(y - pred, -clip, clip), depth, least, 1.0)
        m = Model(edges, 0.0, rate, [t])
        pred += m.predict(x)
        grown.append(t)
    return Model(edges, base, rate, grown)


def cross_predict(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **how: float) -> np.ndarray:
    """Prediction of each row by a model fitted without the row's fold."""
    out = np.full(len(y), float(np.median(y)) if len(y) else 0.0)
    for k in np.unique(fold):
        rest = fold != k
        if rest.sum() >= 10:
            out[~rest] = fit(x[rest], y[rest], **how).predict(x[~rest])
    return out


def best_cuts(pred: np.ndarray, y: np.ndarray, levels: list[float]) -> list[float]:
    """Cut between each two neighbouring levels with the fewest errors (the middle of ties)."""
    cuts = []
    for low, high in zip(levels, levels[1:]):
        at = np.linspace(low, high, 41)
        wrong = [((pred > c) & (y <= low)).sum() + ((pred <= c) & (y >= high)).sum() for c in at]
        tied = np.flatnonzero(np.asarray(wrong) == min(wrong))
        cuts.append(float(at[tied[len(tied) // 2]]))
    return cuts
