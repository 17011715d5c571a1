"""Gradient-boosted trees with monotonic constraints, trained and scored in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees of a model in flat node arrays; root[t] is tree t's first node, a leaf is its own child."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x; NaN goes left."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for r in self.root:
            node = np.full(len(x), r)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            out += self.value[node]
        return out


def _bins(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points halfway between neighbouring quantiles of each column."""
    cuts = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
        cuts.append((q[1:] + q[:-1]) / 2)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Logistic boosting by histograms. monotone: 1, -1 or 0 for each column.

    A split against a column's sign is refused, and both children are bounded by the mean of their values, which keeps
    whole trees (and so their sum) monotone. Without rows, or with one class, the model is a constant.
    """
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.mean() < 1:
        cuts = _bins(x, bins)
        code = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
        width = max(len(c) for c in cuts) + 1
        score = np.full(len(y), base)

        def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
            """The best allowed split of rows: gain, column, cut, values of both children."""
            value = lambda a, b: np.clip(-a / (b + ridge), low, high)
            loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
            found = (1e-6, -1, 0, 0.0, 0.0)
            tg, th = g[rows].sum(), h[rows].sum()
            now = loss(tg, th, value(tg, th))
            for j in range(x.shape[1]):
                c = code[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], width))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=width))[:-1]
                vl, vr = value(gl, hl), value(tg - gl, th - hl)
                gain = now - loss(gl, hl, vl) - loss(tg - gl, th - hl, vr)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                if monotone[j]:
                    gain[monotone[j] * (vr - vl) < 0] = -1
                k = int(np.argmax(gain))
                if gain[k] > found[0] and k < len(cuts[j]):
                    found = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            return found

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
            at = len(nodes)
            own = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
            nodes.append([0, np.inf, at, at, rate * own])
            gain, j, k, vl, vr = best(rows, g, h, low, high) if left_depth and len(rows) >= 2 * least else (0, -1, 0, 0, 0)
            if j < 0:
                score[rows] += rate * own
                return at
            goes = code[rows, j] <= k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
            a = grow(rows[goes], g, h, left_depth - 1, *bounds[0])
            b = grow(rows[~goes], g, h, left_depth - 1, *bounds[1])
            nodes[at] = [j, float(cuts[j][k]), a, b, 0.0]
            return at

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
    flat = np.array(nodes or [[0, np.inf, 0, 0, 0.0]], np.float64)
    return Trees(np.array(roots, np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], base, depth)
