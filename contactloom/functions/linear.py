"""Dense helpers for per-chromosome kernels."""

from __future__ import annotations

import numpy as np


def dense(pdf, size: int, column: str = "v") -> np.ndarray:
    """Matrix of (i, j, value) rows."""
    m = np.zeros((size, size))
    np.add.at(m, (pdf["i"].to_numpy(dtype=np.int64), pdf["j"].to_numpy(dtype=np.int64)), pdf[column].to_numpy(dtype=float))
    return m


def eigenvectors(m: np.ndarray, n: int, smallest: bool = False) -> np.ndarray:
    """The n leading eigenvectors as columns, each with a positive first non-zero entry."""
    if not len(m):
        return np.zeros((0, 0))
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(values if smallest else -np.abs(values), kind="stable")[:n]
    out = vectors[:, order]
    for k in range(out.shape[1]):
        big = np.flatnonzero(np.abs(out[:, k]) > 1e-9)
        if len(big) and out[big[0], k] < 0:
            out[:, k] *= -1
    return out


def normalized_laplacian(m: np.ndarray) -> np.ndarray:
    d = m.sum(axis=0)
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(m)) - scale[:, None] * m * scale[None, :]


def correlation(m: np.ndarray) -> np.ndarray:
    """Pearson correlation of the rows; 0 where a row is constant."""
    x = m - m.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    norm[norm == 0] = np.inf
    x = x / norm[:, None]
    return x @ x.T


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    end = np.r_[start[1:], len(x)]
    out = np.empty(len(x))
    out[order] = ((start + end + 1) / 2)[group]
    return out


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    a, b = ranks(np.asarray(a, dtype=float)), ranks(np.asarray(b, dtype=float))
    if len(a) < 2 or a.std() == 0 or b.std() == 0:
        return float("nan")
    return float(np.corrcoef(a, b)[0, 1])


def ward(distances: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's rule on a distance matrix (Lance-Williams update)."""
    n = len(distances)
    d = distances.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    for _ in range(max(n - k, 0)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        others = live.copy()
        others[[i, j]] = False
        t = size[i] + size[j] + size[others]
        new = ((size[i] + size[others]) * d[i, others] + (size[j] + size[others]) * d[j, others] - size[others] * d[i, j]) / t
        d[i, others] = d[others, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i], live[j] = size[i] + size[j], False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]
