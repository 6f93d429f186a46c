"""Gradient-boosted trees for two classes over a bounded number of rows, and monotone calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 32, 4, 60, 0.2, 1.0, 8


@dataclass
class Boosted:
    """Cuts of each feature, trees as flat arrays (feature, bin, value) of a full binary tree, the first guess."""

    cuts: list[np.ndarray]
    guess: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.empty((2, 0)))  # calibration: raw scores, probabilities

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.empty((0, len(self.cuts)), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.guess)
        for tree in self.trees:
            out += self._leaf(tree, bins)
        return out

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            on = feature[at] >= 0
            right = bins[np.arange(len(bins)), np.maximum(feature[at], 0)] > cut[at]
            at = np.where(on, 2 * at + 1 + right, at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not self.steps.shape[1]:
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.interp(raw, *self.steps)


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    rows = {0: np.arange(len(g))}
    for node in range(nodes):
        own = rows.pop(node, None)
        if own is None:
            continue
        total_g, total_h = g[own].sum(), h[own].sum()
        value[node] = -RATE * total_g / (total_h + RIDGE)
        if node >= 2**DEPTH - 1 or len(own) < 2 * LEAST:
            continue
        best, most = None, 1e-6
        for j in range(bins.shape[1]):
            b = bins[own, j]
            left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=many))[:-1] for w in (g[own], h[own], np.ones(len(own))))
            gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(left_n < LEAST) | (len(own) - left_n < LEAST)] = 0
            k = int(np.argmax(gain))
            if gain[k] > most:
                best, most = (j, k), gain[k]
        if best is None:
            continue
        feature[node], cut[node] = best
        right = bins[own, best[0]] > best[1]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return feature, cut, value


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic loss, Newton steps, splits between quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Boosted(cuts, float(np.log(share / (1 - share))))
    bins, z = model.binned(x), np.full(len(y), model.guess)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        tree = _grow(bins, p - y, p * (1 - p), BINS + 1)
        z += model._leaf(tree, bins)
        model.trees.append(tree)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Monotone probabilities of raw scores from rows that weren't learned from (pooled adjacent violators)."""
    raw = model.raw(x)
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # lowest and highest score, positives, rows
    for r, one in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([r, r, one, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            low, _, a, n = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], a + blocks[-1][2], n + blocks[-1][3]]
    # a block's share is drawn towards a half, so that few rows don't say never or always
    points = [(r, (a + 0.5) / (n + 1)) for low, high, a, n in blocks for r in ([low] if low == high else [low, high])]
    share = np.maximum.accumulate([p for _, p in points]) if points else []
    model.steps = np.array([[r for r, _ in points], share])
