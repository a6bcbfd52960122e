"""Gradient-boosted trees in numpy with monotonic constraints.

Trees are grown on binned features by second-order gain for logistic loss.  A
constrained feature may only split so that the outputs keep its direction, and the
middle between the two outputs bounds everything below (so the whole ensemble is
monotonic).  The trees are flattened into node arrays; scoring walks all rows down
one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees, one behind the other; a leaf points to itself."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, min_rows: int = 10, ridge: float = 1.0) -> Forest:
    """Fit on rows ``x`` (n, features) and labels 0 or 1.

    ``monotone`` maps a feature to +1 (rising) or -1 (falling).  With no rows or one
    label only, the forest is a constant.
    """
    sign = np.zeros(x.shape[1] if x.ndim == 2 else 1, np.int64)
    for f, s in (monotone or {}).items():
        sign[f] = s
    n = len(y)
    rate_1 = (y.sum() + 0.5) / (n + 1.0)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    base = float(np.log(rate_1 / (1 - rate_1)))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            grown = _grow(binned, edges, g, h, sign, depth, min_rows, ridge, nodes, margin, rate)
            roots.append(grown)
    if not nodes:
        nodes.append([0, 0.0, 0, 0, 0.0])
    cols = list(zip(*nodes))
    return Forest(base, depth, np.array(roots, np.int64), np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], float))


def _grow(binned, edges, g, h, sign, depth, min_rows, ridge, nodes, margin, rate) -> int:
    root = len(nodes)
    nodes.append([0, 0.0, root, root, 0.0])
    todo = [(root, np.arange(len(g)), -np.inf, np.inf, 0)]
    width = max((len(e) for e in edges), default=0) + 1
    while todo:
        at, rows, lo, hi, level = todo.pop()
        sg, sh = g[rows].sum(), h[rows].sum()
        value = float(np.clip(sg / (sh + ridge), lo, hi))
        best = None
        if level < depth and len(rows) >= 2 * min_rows:
            for f in range(binned.shape[1]):
                if not len(edges[f]):
                    continue
                b = binned[rows, f]
                cg = np.cumsum(np.bincount(b, weights=g[rows], minlength=width))
                ch = np.cumsum(np.bincount(b, weights=h[rows], minlength=width))
                cn = np.cumsum(np.bincount(b, minlength=width))
                k = np.arange(len(edges[f]))
                lg, lh, ln = cg[k], ch[k], cn[k]
                lv, rv = np.clip(lg / (lh + ridge), lo, hi), np.clip((sg - lg) / (sh - lh + ridge), lo, hi)
                loss = lambda G, H, v: G * v - 0.5 * (H + ridge) * v * v
                gain = loss(lg, lh, lv) + loss(sg - lg, sh - lh, rv) - loss(sg, sh, value)
                ok = (ln >= min_rows) & (len(rows) - ln >= min_rows)
                if sign[f]:
                    ok &= (rv - lv) * sign[f] >= 0
                if ok.any():
                    j = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                        best = (float(gain[j]), f, j, float(lv[j]), float(rv[j]))
        if best is None:
            nodes[at] = [0, 0.0, at, at, value * rate]
            margin[rows] += value * rate
            continue
        _, f, j, lv, rv = best
        left = len(nodes)
        nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]]
        nodes[at] = [f, float(edges[f][j]), left, left + 1, 0.0]
        go = binned[rows, f] <= j
        mid = (lv + rv) / 2
        l_lo, l_hi, r_lo, r_hi = (lo, hi, lo, hi) if not sign[f] else (lo, mid, mid, hi) if sign[f] > 0 else (mid, hi, lo, mid)
        todo += [(left, rows[go], l_lo, l_hi, level + 1), (left + 1, rows[~go], r_lo, r_hi, level + 1)]
    return root
