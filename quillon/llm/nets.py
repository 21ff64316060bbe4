"""Small numpy building blocks that the trained operators share."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam over a dict of float32 arrays, updated in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4):
        self.weights, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.weights[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * self.decay * self.weights[k]


def platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic calibration by damped Newton steps; the slope is kept positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logits + b)
        e, w = weights * (p - labels), weights * p * (1 - p) + 1e-9
        g = np.array([(e * logits).sum() + 1e-2 * (a - 1), e.sum()])
        h = np.array([[(w * logits * logits).sum() + 1e-2, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
