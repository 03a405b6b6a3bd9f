"""Logistic calibration of a few features on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) by Newton steps; with one class only, the intercept alone says so."""
    x = np.column_stack([np.ones(len(x)), x if x.ndim > 1 else x[:, None]])
    w = np.zeros(x.shape[1])
    if len(y) == 0:
        return w
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[0] = 1e-6 * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x if x.ndim > 1 else x[:, None]
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
