"""Gaussian hidden Markov models for one observed sequence (log space)."""

from __future__ import annotations

import numpy as np


def log_normal(x: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Log densities, one column per state; the second parameter is a variance."""
    return -0.5 * (np.log(2 * np.pi * variance) + (x[:, None] - mean) ** 2 / variance)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    a = np.empty_like(emit)
    a[0] = np.log(start + 1e-300) + emit[0]
    lm = np.log(move + 1e-300)
    for t in range(1, len(emit)):
        a[t] = _lse(a[t - 1][:, None] + lm, 0) + emit[t]
    return a


def backward(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    b = np.zeros_like(emit)
    lm = np.log(move + 1e-300)
    for t in range(len(emit) - 2, -1, -1):
        b[t] = _lse(lm + (emit[t + 1] + b[t + 1])[None, :], 1)
    return b


def train(x, start, move, mean, variance, threshold: float = 1e-6, iterations: int = 1000):
    """Baum-Welch until the log-likelihood gains less than the threshold: (start, move, mean, variance, log-likelihood)."""
    x = np.asarray(x, dtype=float)
    start, move, mean, variance = (np.array(p, dtype=float) for p in (start, move, mean, variance))
    before = -np.inf
    for _ in range(iterations):
        emit = log_normal(x, mean, variance)
        a, b = forward(emit, start, move), backward(emit, move)
        ll = float(_lse(a[-1], 0))
        gamma = np.exp(a + b - ll)
        pair = np.zeros_like(move)
        lm = np.log(move + 1e-300)
        for t in range(len(x) - 1):
            pair += np.exp(a[t][:, None] + lm + (emit[t + 1] + b[t + 1])[None, :] - ll)
        start = gamma[0] / gamma[0].sum()
        move = pair / np.maximum(pair.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(axis=0), 1e-12)
        mean = (gamma * x[:, None]).sum(axis=0) / weight
        variance = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-6)
        if ll - before < threshold:
            break
        before = ll
    return start, move, mean, variance, ll


def best_path(x, start, move, mean, variance) -> np.ndarray:
    """Viterbi states."""
    emit = log_normal(np.asarray(x, dtype=float), np.asarray(mean, dtype=float), np.asarray(variance, dtype=float))
    lm = np.log(np.asarray(move) + 1e-300)
    score = np.log(np.asarray(start) + 1e-300) + emit[0]
    back = np.zeros(emit.shape, dtype=int)
    for t in range(1, len(emit)):
        options = score[:, None] + lm
        back[t] = options.argmax(axis=0)
        score = options.max(axis=0) + emit[t]
    path = [int(score.argmax())]
    for t in range(len(emit) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def segment(x, most: int = 5) -> np.ndarray:
    """States of the model with 2 to ``most`` states that has the least BIC; states ordered by mean."""
    x = np.asarray(x, dtype=float)
    z = (x - x.mean()) / (x.std() or 1.0)
    best = None
    for n in range(2, most + 1):
        if len(z) < 5 * n:
            break
        mean = np.quantile(z, (np.arange(n) + 0.5) / n)
        move = np.full((n, n), 0.1 / max(n - 1, 1))
        np.fill_diagonal(move, 0.9)
        *model, ll = train(z, np.full(n, 1 / n), move, mean, np.full(n, 0.5), iterations=100)
        bic = -2 * ll + (n * n + 2 * n - 1) * np.log(len(z))
        if best is None or bic < best[0]:
            best = (bic, model)
    if best is None:
        return (z > 0).astype(int)
    path = best_path(z, *best[1])
    order = np.argsort(np.argsort(best[1][2]))
    return order[path]
