"""Gradient-boosted trees for binary labels, in numpy: small, deterministic, and shipped with the tasks."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting over binned features; depth-limited trees grown level by level on histograms."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin, leaf value, as complete trees
        self.base = 0.0
        self.slope, self.shift = 1.0, 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > self.bins:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]))
            else:
                values = values[:-1]
            self.edges.append(values.astype(np.float64))
        b = self._bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.base)
        n_bins = max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            feature, threshold, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                live = (at >= first) & (at < first + width)
                local = at[live] - first
                best = np.full(width, 1e-4)
                tg, th = np.bincount(local, g[live], width), np.bincount(local, h[live], width)
                parent = tg**2 / (th + self.ridge)
                for j in range(x.shape[1]):
                    m = len(self.edges[j]) + 1
                    if m < 2:
                        continue
                    slot = local * n_bins + b[live, j]
                    hg = np.bincount(slot, g[live], width * n_bins).reshape(width, n_bins)[:, : m - 1].cumsum(1)
                    hh = np.bincount(slot, h[live], width * n_bins).reshape(width, n_bins)[:, : m - 1].cumsum(1)
                    rg, rh = tg[:, None] - hg, th[:, None] - hh
                    gain = hg**2 / (hh + self.ridge) + rg**2 / (rh + self.ridge) - parent[:, None]
                    gain[(hh < self.least) | (rh < self.least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = j
                    threshold[first : first + width][better] = k[better]
                split = feature[at] >= 0
                moves = live & split
                at[moves] = 2 * at[moves] + 1 + (b[moves, feature[at[moves]]] > threshold[at[moves]])
            tg, th = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
            value = self.rate * tg / (th + self.ridge)
            f += value[at]
            self.trees.append((feature, threshold, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not len(x):
            return f
        b = self._bin(x)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                go = j >= 0
                at = np.where(go, 2 * at + 1 + (b[rows, np.maximum(j, 0)] > threshold[at]), at)
            f += value[at]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
        """Fit slope and shift of the raw score on held-out rows (Platt scaling by Newton steps)."""
        s = self.raw(x)
        a, c = 1.0, 0.0

        def loss(a: float, c: float) -> float:
            z = a * s + c
            return float((np.logaddexp(0, z) - y * z).sum() + 5e-4 * a * a)

        at = loss(a, c)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9)
            grad = np.array([((p - y) * s).sum() + 1e-3 * a, (p - y).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            size = 1.0
            while size > 1e-6 and loss(a - size * step[0], c - size * step[1]) > at:  # never uphill
                size /= 2
            a, c = a - size * step[0], c - size * step[1]
            at = loss(a, c)
            if size * np.abs(step).max() < 1e-8 or size <= 1e-6:
                break
        self.slope, self.shift = float(a), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
