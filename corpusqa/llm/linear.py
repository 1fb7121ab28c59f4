"""Linear classifiers fitted on the driver to a bounded number of rows."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, weights=None) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine, by dual coordinate descent.

    Each row is (positions, values), each sign 1 or -1. One row's dual variable is solved for at a time and kept
    between 0 and ``cost`` (times the row's own weight); a row at a bound whose gradient points outwards is passed over.
    """
    w = np.zeros(size + 1)
    held = np.zeros(len(rows))
    most = np.full(len(rows), cost) if weights is None else cost * np.asarray(weights)
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order, shuffle = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        shuffle.shuffle(order)
        moved = 0.0
        for n in order.tolist():
            at, values = rows[n]
            gradient = signs[n] * (values @ w[at] + w[-1]) - 1.0
            new = min(max(held[n] - gradient / norms[n], 0.0), most[n])
            step = new - held[n]
            if step:
                held[n] = new
                w[at] += step * signs[n] * values
                w[-1] += step * signs[n]
                moved = max(moved, abs(step) * norms[n] ** 0.5)
        if moved < 1e-3:
            break
    return w


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a m + b))) is the likelihood of a positive row, by Newton steps on smoothed targets."""
    p, n = weights[positive].sum(), weights[~positive].sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, float(np.log((p + 1) / (n + 1)))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    loss = lambda t: float((weights * (np.logaddexp(0, x @ t) - target * (x @ t))).sum())
    t = np.array([a, b])
    for _ in range(60):
        q = sigmoid(x @ t)
        gradient = x.T @ (weights * (q - target))
        hessian = (x * (weights * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(t)
        size = 1.0
        while size > 1e-6 and loss(t - size * step) > now:
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(t[0]), float(t[1])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
