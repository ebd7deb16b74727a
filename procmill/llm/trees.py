"""Gradient-boosted classification trees over a bounded sample, in numpy; small enough to broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth. cuts[f]: ascending cuts of feature f; each tree: (class, features, bins, leaf values)."""

    n_classes: int
    cuts: list[np.ndarray]
    prior: np.ndarray
    depth: int
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1).astype(np.int32)

    def _leaf(self, b: np.ndarray, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for d in range(self.depth):
            k = (1 << d) - 1 + node
            node = 2 * node + (b[rows, feats[k]] > at[k])
        return node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.tile(self.prior, (len(x), 1))
        for c, feats, at, leaves in self.trees:
            out[:, c] += leaves[self._leaf(b, feats, at)]
        return out

    def classes(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.raw(x), axis=1) if len(x) else np.empty(0, int)


def fit(x: np.ndarray, y: np.ndarray, n_classes: int, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, n_bins: int = 32) -> Trees:
    """Trees for features x and classes y; the same input gives the same trees. Classes that don't occur are never answered."""
    x = np.nan_to_num(x)
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) < n_bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])))
    share = np.bincount(y, minlength=n_classes) / len(y)
    model = Trees(n_classes, cuts, np.where(share > 0, np.log(np.maximum(share, 1e-9)), -1e9), depth)
    b = model.bins(x)
    width = max(len(c) for c in cuts) + 1
    offsets = np.arange(x.shape[1]) * width
    flat = b + offsets
    score = np.tile(model.prior, (len(y), 1))
    target = np.eye(n_classes)[y]
    present = np.flatnonzero(share > 0)
    for _ in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in present:
            g, h = p[:, c] - target[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            feats, at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
            node = np.zeros(len(y), np.int64)
            for d in range(depth):
                size = 1 << d
                key = (node[:, None] * (x.shape[1] * width) + flat).reshape(-1)
                many = size * x.shape[1] * width
                gs = np.bincount(key, np.repeat(g, x.shape[1]), many).reshape(size, x.shape[1], width).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, x.shape[1]), many).reshape(size, x.shape[1], width).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hs > 0.05) & (ht - hs > 0.05), gain, -1.0).reshape(size, -1)
                best = gain.argmax(axis=1)
                ok = gain[np.arange(size), best] > 1e-6
                k = slice(size - 1, 2 * size - 1)
                feats[k] = np.where(ok, best // width, 0)
                at[k] = np.where(ok, best % width, width)
                node = 2 * node + (b[np.arange(len(y)), feats[size - 1 + node]] > at[size - 1 + node])
            gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
            leaves = -rate * gs / (hs + ridge)
            score[:, c] += leaves[node]
            model.trees.append((int(c), feats, at, leaves))
    return model
