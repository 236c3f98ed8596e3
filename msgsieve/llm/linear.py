"""Linear models of two classes on a bounded sample: Newton steps solved by conjugate gradients."""

from __future__ import annotations

import numpy as np


def _logistic(margin: np.ndarray):
    """Loss, its slope and its curvature by the signed margin."""
    p = 1 / (1 + np.exp(np.clip(margin, -60, 60)))
    return np.logaddexp(0, -margin), -p, p * (1 - p)


def _squared_hinge(margin: np.ndarray):
    short = np.maximum(1 - margin, 0)
    return short * short, -2 * short, np.where(short > 0, 2.0, 0.0)


LOSSES = {"logistic": _logistic, "svm": _squared_hinge}


def fit(x: np.ndarray, positive: np.ndarray, loss: str, penalty: float, steps: int = 30) -> tuple[float, np.ndarray]:
    """Intercept and weights; minus or plus infinity and zeros if all rows are of one class.

    Minimises the mean loss of ``x @ w + b`` plus ``penalty / 2`` times the squared weights of the columns
    scaled to unit deviation. ``svm`` is the linear support vector machine with the squared hinge.
    """
    if positive.all() or not positive.any():
        return (float("inf") if len(positive) and positive.all() else float("-inf")), np.zeros(x.shape[1])
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([x / scale, np.ones(len(x), x.dtype)])
    sign = np.where(positive, 1.0, -1.0)
    held = np.append(np.full(x.shape[1], penalty), 0.0)
    w, of = np.zeros(z.shape[1]), LOSSES[loss]

    def objective(w):
        return of(sign * (z @ w.astype(z.dtype)))[0].mean() + 0.5 * (held * w * w).sum()

    now = objective(w)
    for _ in range(steps):
        _, slope, curve = of(sign * (z @ w.astype(z.dtype)))
        gradient = z.T @ (sign * slope).astype(z.dtype) / len(z) + held * w
        if np.linalg.norm(gradient) < 1e-5:
            break
        curve = curve.astype(z.dtype)
        step, rest = np.zeros_like(w), -gradient
        along, size = rest.copy(), rest @ rest
        for _ in range(25):
            bent = z.T @ (curve * (z @ along.astype(z.dtype))) / len(z) + held * along + 1e-9 * along
            pace = size / max(along @ bent, 1e-30)
            step, rest = step + pace * along, rest - pace * bent
            new = rest @ rest
            if new < 1e-3 * (gradient @ gradient):
                break
            along, size = rest + new / size * along, new
        pace = 1.0
        while pace > 1e-4 and objective(w + pace * step) > now:
            pace /= 2
        if pace <= 1e-4:
            break
        w = w + pace * step
        now = objective(w)
    return float(w[-1]), w[:-1] / scale
