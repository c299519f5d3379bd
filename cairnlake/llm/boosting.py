"""Gradient-boosted trees on histograms, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself and its threshold is infinite."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Fit log loss.  monotone: by feature, +1 if the score may only rise with it, -1 if only fall.

    A split of a constrained feature is allowed only if its children's values are in order, and both children
    are then held on their side of the mean of the two values, so that no deeper split can break the order.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    nodes: list[list] = []
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        top = None
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(width):
            if not len(cuts[j]):
                continue
            b = binned[rows, j]
            size = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
            cl = np.cumsum(np.bincount(b, minlength=size))[:-1]
            gr, hr, cr = gs - gl, hs - hl, len(rows) - cl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
            ok = (cl >= least) & (cr >= least)
            if sign := monotone.get(j, 0):
                ok &= sign * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if np.isfinite(gain[k]) and (top is None or gain[k] > top[0]):
                top = (gain[k], j, k, vl[k], vr[k])
        whole = np.clip(-gs / (hs + l2), low, high)
        flat = -(gs * whole + 0.5 * (hs + l2) * whole**2)
        return top if top is not None and top[0] > flat + 1e-9 else None

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        split = best(rows, g, h, low, high) if level < depth and len(rows) >= 2 * least else None
        if split is None:
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high)) * rate
            margin[rows] += value
            return leaf(value)
        _, j, k, vl, vr = split
        me = leaf(0.0)
        goes = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(monotone.get(j, 0), ((low, high), (low, high)))
        a = grow(rows[goes], g, h, level + 1, *bounds[0])
        b = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[me] = [j, float(cuts[j][k]), a, b, 0.0]
        return me

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    flat = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    return Trees(*(np.array(v, k) for v, k in zip(flat, kinds, strict=True)), np.array(roots, np.int32), depth, base)
