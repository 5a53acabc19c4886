"""Logistic regression over hashed binary features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 16


def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


class HashedLogistic:
    """Weights of 2**BITS slots; each example is an array of slots."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.w = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.b = bias

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, batch: int = 128, seed: int = 7) -> "HashedLogistic":
        """AdaGrad over shuffled mini-batches."""
        if not len(rows):
            return self
        length = np.array([len(r) for r in rows])
        start = np.concatenate([[0], np.cumsum(length)])
        flat = np.concatenate(rows)
        rng = np.random.default_rng(seed)
        grad2 = np.full(len(self.w), 1e-6)
        w, b, b2 = self.w.astype(np.float64), self.b, 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                n = length[pick]
                owner = np.repeat(np.arange(len(pick)), n)
                cols = flat[np.repeat(start[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                z = np.bincount(owner, w[cols], len(pick)) + b
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
                used, inv = np.unique(cols, return_inverse=True)
                g = np.bincount(inv, err[owner]) / len(pick) + l2 * w[used]
                grad2[used] += g * g
                w[used] -= rate * g / np.sqrt(grad2[used])
                gb = err.mean()
                b2 += gb * gb
                b -= rate * gb / np.sqrt(b2)
        self.w, self.b = w.astype(np.float32), float(b)
        return self

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        z = np.bincount(owner, self.w[np.concatenate(rows)], len(rows)) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
