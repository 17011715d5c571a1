"""Cutting stock by column generation: which classes of lengths share a sequence, and how often. Numpy only."""

from __future__ import annotations

import numpy as np


def _price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest value that fits: an unbounded knapsack, by dynamic programming over capacities."""
    worth, index = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    worth[size], index[size] = value, np.arange(len(size))
    back, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # back[capacity - w]: the best value of w
    for w in range(1, capacity + 1):
        total = back[capacity - w + 1 :] + worth[1 : w + 1]  # each size up to w with the best of what it leaves
        k = int(total.argmax())
        last = back[capacity - w + 1]
        if total[k] > last + 1e-12:
            back[capacity - w], pick[w] = total[k], k + 1
        else:
            back[capacity - w] = last
    pattern, w = np.zeros(len(size), np.int64), capacity
    while w > 0:
        if pick[w]:
            pattern[index[pick[w]]] += 1
            w -= int(pick[w])
        else:
            w -= 1
    return float(back[0]), pattern


def _inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination without BLAS, whose threads would wait for busy cores."""
    n = len(m)
    a = np.concatenate([m, np.eye(n)], 1)
    for k in range(n):
        top = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, top]] = a[[top, k]]
        a[k] /= a[k, k]
        column = a[:, k].copy()
        column[k] = 0
        rows = np.flatnonzero(column)
        a[rows] -= np.outer(column[rows], a[k])
    return a[:, n:].copy()


def relax(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000, patience: int = 150) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often the linear program uses each (fractions), by the revised simplex method.

    Columns are made as they are needed: the duals price classes, the knapsack finds the pattern of the highest price,
    and it enters the basis while that price is above one sequence. Degenerate demands end when patience rounds in a
    row save nothing; rounds bounds the work. Any basis covers the demand.
    """
    m = len(size)
    patterns = [np.eye(m, dtype=np.int64)[i] * int(capacity // size[i]) for i in range(m)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    times = lambda v: (inverse * v).sum(1)
    x = times(demand)
    best, since = x.sum(), 0
    for step in range(rounds):
        if step % 500 == 499:  # rounding errors don't add up
            inverse = _inverse(np.stack(patterns, 1).astype(float))
            x = np.maximum(times(demand), 0)
        since = since + 1 if x.sum() > best * (1 - 1e-7) else 0
        best = min(best, x.sum())
        if since > patience:
            break
        price, column = _price(np.maximum(inverse.sum(0), 0), size, capacity)
        if price <= 1 + 1e-7:
            break
        way = times(column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        patterns[out] = column
        inverse[out] /= way[out]
        way[out] = 0
        inverse -= np.outer(way, inverse[out])
    return patterns, x


def _fill(size: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """One pattern from what is left: the largest class first, then the fullest sum that can be reached."""
    pattern = np.zeros(len(size), np.int64)
    big = int(max(np.flatnonzero(left), key=lambda i: size[i]))
    pattern[big] = 1
    room = capacity - int(size[big])
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero(left):
        n, k = int(left[i]) - int(i == big), 1
        n = min(n, int(room // size[i]))
        while n > 0:
            parts.append((int(i), min(k, n)))
            n -= min(k, n)
            k *= 2
    reach, mask = [1], (1 << (room + 1)) - 1
    for i, n in parts:
        reach.append((reach[-1] | reach[-1] << (n * int(size[i]))) & mask)
    w = reach[-1].bit_length() - 1
    for k in range(len(parts), 0, -1):
        if not reach[k - 1] >> w & 1:
            i, n = parts[k - 1]
            pattern[i] += n
            w -= n * int(size[i])
    return pattern


def cut(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each class) and whole numbers of sequences that use them; together they meet the demand."""
    if not len(size):
        return []
    found: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    patterns, x = relax(size, demand.astype(float), capacity)
    for p, n in sorted(zip(patterns, x, strict=True), key=lambda t: -t[1]):
        n = int(n + 1e-6)
        if n:
            n = int(min(n, *(left[p > 0] // p[p > 0])))
        if n:
            found.append((p, n))
            left = left - n * p
    while left.any():
        p = _fill(size, left, capacity)
        n = int((left[p > 0] // p[p > 0]).min())
        found.append((p, n))
        left = left - n * p
    return found
