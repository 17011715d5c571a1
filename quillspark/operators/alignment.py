"""Assignments within a group: optimal, greedy, best evidence; and geometry. A group is one document's items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.similarity import partial_of, ratio_of


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum-cost assignment, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            now = c[match[j] - 1] - u[match[j]] - v[1:]
            free = ~used[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def _per_group(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(f, schema)


def optimal(df: DataFrame, key: str = "doc", least: float = 0.0) -> DataFrame:
    """The alignment of truths and findings of each document with the highest total ratio.

    df: key long, side ("truth" or "found"), position long, text. Returns truth and found positions with the ratio, null
    on a side without partner; pairs below least are no pairs.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, f = (g[g.side == s].sort_values("position") for s in ("truth", "found"))
        score = np.array([[ratio_of(a, b) for b in f.text] for a in t.text]).reshape(len(t), len(f))
        pairs = [(i, j) for i, j in assignment(-score) if score[i, j] >= least] if score.size else []
        rows = [(t.position.iloc[i], f.position.iloc[j], score[i, j]) for i, j in pairs]
        rows += [(p, None, None) for i, p in enumerate(t.position) if i not in {a for a, _ in pairs}]
        rows += [(None, p, None) for j, p in enumerate(f.position) if j not in {b for _, b in pairs}]
        return pd.DataFrame([(g[key].iloc[0], *r) for r in rows], columns=[key, "truth", "found", "score"]).astype({"truth": "Int64", "found": "Int64", "score": "float64"})

    return _per_group(df, key, run, f"{key} long, truth long, found long, score double")


def greedy(df: DataFrame, key: str = "doc", least: float = 70.0) -> DataFrame:
    """Findings in order, each with the best truth over least that is still free (ties: the first)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, f = (g[g.side == s].sort_values("position") for s in ("truth", "found"))
        free, rows = dict(zip(t.position, t.text, strict=True)), []
        for p, text in zip(f.position, f.text, strict=True):
            best = max(free, key=lambda q: (ratio_of(free[q], text), -q), default=None)
            if best is not None and ratio_of(free[best], text) > least:
                rows.append((g[key].iloc[0], best, p, ratio_of(free.pop(best), text)))
        return pd.DataFrame(rows, columns=[key, "truth", "found", "score"]).astype({"truth": "Int64", "found": "Int64", "score": "float64"})

    return _per_group(df, key, run, f"{key} long, truth long, found long, score double")


def best_evidence(df: DataFrame, key: str = "doc") -> DataFrame:
    """For every finding the pool text (side "truth") with the highest partial ratio, the first of equals."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, f = (g[g.side == s].sort_values("position") for s in ("truth", "found"))
        rows = []
        for p, text in zip(f.position, f.text, strict=True):
            scores = [partial_of(text, x) for x in t.text]
            k = int(np.argmax(scores)) if scores else None
            rows.append((g[key].iloc[0], p, None if k is None else t.position.iloc[k], None if k is None else scores[k]))
        return pd.DataFrame(rows, columns=[key, "found", "truth", "score"]).astype({"truth": "Int64", "found": "Int64", "score": "float64"})

    return _per_group(df, key, run, f"{key} long, found long, truth long, score double")


def merge_boxes(df: DataFrame, key: str = "page", gap: float = 18.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) joined while any two lie within gap of each other."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        boxes = [tuple(b) for b in g[["x0", "y0", "x1", "y1"]].sort_values(["x0", "y0", "x1", "y1"]).to_numpy()]
        moved = True
        while moved:
            moved, out = False, []
            for b in boxes:
                for i, o in enumerate(out):
                    if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                        out[i] = (min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]))
                        moved = True
                        break
                else:
                    out.append(b)
            boxes = out
        return pd.DataFrame([(g[key].iloc[0], *b) for b in sorted(boxes)], columns=[key, "x0", "y0", "x1", "y1"])

    return _per_group(df, key, run, f"{key} long, x0 double, y0 double, x1 double, y1 double")


def median_boxes(df: DataFrame, key: str = "layout", near: float = 0.035, support: float = 0.35) -> DataFrame:
    """Median boxes of clusters of boxes whose centres lie near the first of the cluster, if enough pages have them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["page", "x0", "y0", "x1", "y1"])
        clusters: list[list] = []
        for r in g.itertuples():
            c = ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2)
            home = next((k for k in clusters if abs(k[0][0] - c[0]) <= near and abs(k[0][1] - c[1]) <= near), None)
            if home is None:
                clusters.append([c, [r]])
            else:
                home[1].append(r)
        least = int(np.ceil(support * g.page.nunique()))
        rows = [(g[key].iloc[0], *(float(np.median([getattr(r, s) for r in k[1]])) for s in ("x0", "y0", "x1", "y1")), len(k[1])) for k in clusters if len(k[1]) >= least]
        return pd.DataFrame(rows, columns=[key, "x0", "y0", "x1", "y1", "support"])

    return _per_group(df, key, run, f"{key} long, x0 double, y0 double, x1 double, y1 double, support long")
