"""Logistic regression on a bounded sample, by Newton steps in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last; columns are scaled inside so that the ridge treats them alike."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ beta)
        slope = design.T @ (weight * (y - p)) - penalty @ beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    own = beta[:-1] / scale
    return np.append(own, beta[-1] - own @ mean)
