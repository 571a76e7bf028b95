"""Small numeric functions."""

from __future__ import annotations

import bisect
import math

import numpy as np


def zscore(values: list[float]) -> list[float]:
    """Standardised log10 values (population deviation)."""
    logs = [math.log10(v) for v in values]
    mean = sum(logs) / len(logs)
    sd = math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs))
    return [(x - mean) / sd for x in logs]


def log_or_half_minimum(values: list[float]) -> list[float]:
    """log10 with zeros replaced by half of the least positive value."""
    least = min((v for v in values if v > 0), default=1.0)
    return [math.log10(v if v > 0 else least / 2) for v in values]


def log10_or_infinity(values) -> np.ndarray:
    """log10 with minus infinity for zeros."""
    with np.errstate(divide="ignore"):
        return np.log10(np.asarray(values, dtype=float))


def explained(f, xs, ys) -> float:
    """Share of the variance of ``ys`` that a function of ``xs`` explains."""
    ys = np.asarray(ys, dtype=float)
    gaps = ys - np.array([f(x) for x in xs], dtype=float)
    return float(1 - (gaps @ gaps) / ((ys - ys.mean()) @ (ys - ys.mean())))


def mean_of_known(values: list[float | None]) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def mad(values) -> float:
    x = np.asarray(values, dtype=float)
    return float(np.median(np.abs(x - np.median(x))))


class Interpolation:
    """Piecewise linear function through points with increasing x."""

    def __init__(self, xs: list[float], ys: list[float]):
        if any(b <= a for a, b in zip(xs, xs[1:], strict=False)):
            raise ValueError("x must increase")
        self.xs, self.ys = list(xs), list(ys)

    def __call__(self, x: float) -> float:
        i = min(max(bisect.bisect_right(self.xs, x) - 1, 0), len(self.xs) - 2)
        slope = (self.ys[i + 1] - self.ys[i]) / (self.xs[i + 1] - self.xs[i])
        return self.ys[i] + slope * (x - self.xs[i])


def chain_square_distance(length: float, persistence: float) -> float:
    """Mean squared end-to-end distance of a worm-like chain."""
    p = persistence
    return 2 * p * length * (1 - p / length * (1 - math.exp(-length / p))) if length > 0 else 0.0


def persistence_length(contour: float, square: float, guess: float = 1.0, steps: int = 2000, accuracy: float = 1e-12) -> float:
    """The persistence length at which a chain of this contour has this squared distance (Newton steps, kept positive)."""
    x = guess
    for _ in range(steps):
        f = chain_square_distance(contour, x) - square
        h = max(abs(x), 1e-6) * 1e-6
        slope = (chain_square_distance(contour, x + h) - chain_square_distance(contour, x - h)) / (2 * h)
        if slope == 0:
            break
        following = x - f / slope
        following = following if following > 0 else x / 2
        if abs(following - x) < accuracy:
            return following
        x = following
    return x


def fit_persistence(points: list[tuple[float, float]], low: float = 1e-3, high: float = 1e6) -> float:
    """Least-squares persistence length of (contour, squared distance) points, by golden section on its logarithm."""
    loss = lambda p: sum((chain_square_distance(x, p) - y) ** 2 for x, y in points)
    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(math.exp(c)) < loss(math.exp(d)) else (c, b)
    return math.exp((a + b) / 2)


def depth_histogram(totals: np.ndarray, classes: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower edges, counts, kept totals): the highest totals are left out one by one while over half of the classes are empty."""
    kept = np.sort(np.asarray(totals, dtype=float))
    while len(kept):
        width = (kept[-1] - kept[0]) / (classes - 1) or 1.0
        counts = np.bincount(((kept - kept[0]) / width + 1e-9).astype(int), minlength=classes)[:classes]
        if (counts == 0).sum() <= classes / 2 or kept[-1] == kept[0]:
            return kept[0] + width * np.arange(classes), counts, kept
        kept = kept[:-1]
    return np.zeros(classes), np.zeros(classes, dtype=int), kept


def low_root(totals, orders=range(6, 18)) -> float:
    """Where the histogram of totals first dips: the first minimum, below the fifth percentile, of the polynomial that fits it best; 0 if there is none.

    Of a polynomial's two lowest extremes the first is taken if the curve rises after it,
    else the second.  Orders above 13 pay a thirtieth of the order in fit.
    """
    totals = np.asarray(totals, dtype=float)
    if not len(totals):
        return 0.0
    edges, counts, kept = depth_histogram(totals)
    fifth, best = np.percentile(totals, 5), (-math.inf, 0.0)
    spread = ((counts - counts.mean()) ** 2).sum()
    if kept[-1] <= kept[0] or not spread:
        return 0.0
    for order in orders:
        curve = np.polynomial.Polynomial.fit(edges, counts, order)
        slope = curve.deriv()
        flat = np.sort([r.real for r in slope.roots() if abs(r.imag) < 1e-9 * max(abs(r.real), 1.0)])
        if len(flat) < 2:
            continue
        root = flat[0] if slope((flat[0] + flat[1]) / 2) > 0 else flat[1]
        if 0 < root < fifth:
            fit = 1 - ((counts - curve(edges)) ** 2).sum() / spread - (order / 30 if order > 13 else 0)
            best = max(best, (fit, float(root)))
    return best[1]


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at least k successes."""
    if k <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs, default=-math.inf)
    return math.exp(top) * sum(math.exp(v - top) for v in logs) if logs else 0.0


def likely_enzymes(hits: dict[str, int], reads: int, lengths: dict[str, int], level: float = 1e-6) -> list[tuple[str, float]]:
    """(enzyme, p) of enzymes whose filled end starts more reads than chance allows, the most likely first.

    By chance a read starts with a motif of n known bases with probability 4^-n.
    """
    tested = [(name, binomial_tail(k, reads, 0.25 ** lengths[name])) for name, k in hits.items()]
    return sorted(((n, p) for n, p in tested if p < level), key=lambda x: (x[1], -hits[x[0]] * 4.0 ** lengths[x[0]], x[0]))


def stable_window(share: np.ndarray, size: int, low: float, high: float) -> int:
    """The first of ten successive window sizes whose medians between two depth quantiles all agree with their middle within a deviation."""
    n_windows = min(1000, size // 10)
    first, last = int(size * low), int(size * high)
    if n_windows < 1 or (last - first) // n_windows < 1:
        return 1
    at = np.arange(first, last, (last - first) // n_windows)[:n_windows]
    found, streak = 1, 0
    for window in np.unique(np.logspace(1, 4, 100).astype(int)):
        parts = [share[k : k + window] for k in at]
        if not all(len(p) for p in parts):
            break
        middle, sd = np.array([np.median(p) for p in parts]), np.array([p.std() for p in parts])
        centre = np.median(middle)
        if ((middle - sd < centre) & (centre < middle + sd)).all():
            found, streak = (window if not streak else found), streak + 1
            if streak == 10:
                break
        else:
            streak = 0
    return int(found)


def _first_run(ok: np.ndarray, length: int) -> int | None:
    """Start of the first run of at least ``length`` true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, ok, False]))
    runs = [a for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= length]
    return int(runs[0]) if runs else None


def depth_limits(
    share: np.ndarray, size: int, low: float = 0.3, high: float = 0.8, sigma: float = 2.0, min_perc: float | None = None, max_perc: float | None = None, run: int = 11
) -> tuple[int, int]:
    """(left, right): ranks of depth between which the cis share is ordinary.

    Bands of ``sigma`` deviations around the median run over the shares in the order of depth.  A place fits if both
    bands lie within ``sigma`` deviations of their median between the quantiles; the limits are the outer ends of the
    first and the last run of ``run`` fitting places.  Percentages given by hand overrule them.
    """
    window = stable_window(share, size, low, high)
    upper, lower = np.full(size, np.nan), np.full(size, np.nan)
    whole = np.lib.stride_tricks.sliding_window_view(share, window) if len(share) >= window else np.zeros((0, window))
    for a in range(0, len(whole), 10_000):
        part = whole[a : a + 10_000]
        middle, sd = np.median(part, axis=1), part.std(axis=1)
        upper[a : a + len(part)], lower[a : a + len(part)] = middle + sigma * sd, middle - sigma * sd
    for k in range(len(whole), min(len(share), size)):  # windows that the end cuts off
        middle, sd = np.median(share[k:]), share[k:].std()
        upper[k], lower[k] = middle + sigma * sd, middle - sigma * sd
    ok = np.ones(size, dtype=bool)
    for band in (upper, lower):
        inner = band[int(size * low) : int(size * high)]
        centre, sd = np.median(inner), inner.std()
        ok &= (centre - sigma * sd < band) & (band < centre + sigma * sd)
    left, right = _first_run(ok, run), _first_run(ok[::-1], run)
    if left is None and min_perc is None or right is None and max_perc is None:
        raise ValueError("no run of ordinary bins was found; give min_perc and max_perc by hand")
    left = int(min_perc / 100 * size) if min_perc else int(left or 0)
    right = int(max_perc / 100 * size) if max_perc else int(size - (right or 0))
    return left, right
