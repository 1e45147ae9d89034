"""What the trained models share: gradient steps, and splitting labels for learning."""

from __future__ import annotations

import numpy as np


class Adam:
    """Adam steps over named arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.weights[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the offset) of a logistic regression penalised for leaving ``prior`` (zero), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    mean = np.zeros(x.shape[1]) if prior is None else prior
    w = mean.copy()
    ridge = penalty * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (w - mean))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
