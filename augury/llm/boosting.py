"""A small gradient-boosted tree classifier for a few thousand rows of a few features.

Works on arrays without missing values.  Ties between splits go to the earlier feature
and cut; repeated rows count each; without rows of both classes nothing is split and
the probability is the calibrated base rate; no rows are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Boosted:
    """Depth-two trees: (feature, cut) at the root and below each side, four leaf values."""

    base: float
    trees: list[tuple[tuple[int, float], tuple[int, float], tuple[int, float], np.ndarray]]
    #: Isotonic map from raw probability to calibrated probability.
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for root, low, high, leaf in self.trees:
            right = x[:, root[0]] > root[1]
            below = np.where(right, x[:, high[0]] > high[1], x[:, low[0]] > low[1])
            z += leaf[2 * right + below]
        return _sigmoid(z)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for interpolation."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, first p, last p
    for a, b in zip(p[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    best, where = 0.0, (0, np.inf)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, at in enumerate(cuts):
        for cut in at:
            right = rows & (x[:, f] > cut)
            gr, hr = g[right].sum(), h[right].sum()
            gain = gr**2 / (hr + 1) + (total_g - gr) ** 2 / (total_h - hr + 1) - total_g**2 / (total_h + 1)
            if gain > best + 1e-12:
                best, where = gain, (f, float(cut))
    return where


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, calibrate: tuple[np.ndarray, np.ndarray] | None = None) -> Boosted:
    """Boost on all rows and calibrate on those given; without such, on every third row, which is then kept out."""
    if not len(x):
        raise ValueError("no rows to fit on")
    kept = np.arange(len(x)) % 3 == 2 if calibrate is None else np.zeros(len(x), dtype=bool)
    cx, cy = (x[kept], y[kept]) if calibrate is None else calibrate
    tx, ty = x[~kept], y[~kept].astype(float)
    cuts = [np.unique(np.quantile(tx[:, f], np.linspace(0.05, 0.95, 8), method="lower")) for f in range(x.shape[1])]
    base = float(np.log((ty.mean() + 1e-6) / (1 - ty.mean() + 1e-6)))
    out = Boosted(base, [], (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    z = np.full(len(tx), base)
    for _ in range(rounds):
        p = _sigmoid(z)
        g, h = ty - p, p * (1 - p)
        every = np.ones(len(tx), dtype=bool)
        root = _split(tx, g, h, every, cuts)
        right = tx[:, root[0]] > root[1]
        low, high = _split(tx, g, h, ~right, cuts), _split(tx, g, h, right, cuts)
        below = np.where(right, tx[:, high[0]] > high[1], tx[:, low[0]] > low[1])
        leaf = np.zeros(4)
        for k in range(4):
            rows = 2 * right + below == k
            leaf[k] = rate * g[rows].sum() / (h[rows].sum() + 1)
        z += leaf[2 * right + below]
        out.trees.append((root, low, high, leaf))
    if len(cx):
        out.knots = isotonic(out.raw(cx), cy)
    return out
