"""Linear models on sparse rows, fitted by the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Rows:
    """Sparse rows of ones: for each row the numbers of its columns."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.column = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.height, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.height)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.width)


def logistic(rows: Rows, target: np.ndarray, weight: np.ndarray, steps: int = 2000, rate: float = 0.05, decay: float = 1e-6):
    """Weights and bias that make the weighted log loss against soft targets least."""
    w, adam = np.zeros(rows.width + 1), Adam(rows.width + 1, rate)
    scale = max(1e-9, float(weight.sum()))
    for _ in range(steps):
        g = (sigmoid(rows.dot(w[:-1]) + w[-1]) - target) * weight / scale
        w = adam.step(w, np.r_[rows.back(g) + decay * w[:-1], g.sum()])
    return w[:-1], float(w[-1])
