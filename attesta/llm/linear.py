"""Logistic regression on a bounded sample, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """L2-penalised logistic regression by Newton steps on standardised features."""

    def __init__(self, penalty: float = 1.0, steps: int = 12):
        self.penalty, self.steps = penalty, steps
        self.mean = self.scale = self.weights = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        w = np.zeros(z.shape[1])
        penalty = np.r_[np.full(x.shape[1], self.penalty), 1e-3]
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (p - y) + penalty * w
            hessian = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-5:
                break
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
