"""Geometry of particle models (numpy)."""

from __future__ import annotations

import math

import numpy as np


def sphere_points(n: int = 100) -> np.ndarray:
    """Evenly spread points on the unit sphere (golden spiral)."""
    k = np.arange(n)
    y = 1 - (2 * k + 1) / n
    r, t = np.sqrt(1 - y * y), k * math.pi * (3 - math.sqrt(5))
    return np.stack([r * np.cos(t), y, r * np.sin(t)], axis=1)


def circle_points(centre, axis, radius: float, n: int) -> np.ndarray:
    """n points on the circle around an axis."""
    axis = np.asarray(axis, dtype=float) / np.linalg.norm(axis)
    side = np.cross(axis, [1.0, 0, 0] if abs(axis[0]) < 0.9 else [0, 1.0, 0])
    side /= np.linalg.norm(side)
    other = np.cross(axis, side)
    t = np.arange(n) * 2 * math.pi / n
    return np.asarray(centre) + radius * (np.cos(t)[:, None] * side + np.sin(t)[:, None] * other)


def centred(x: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    return x - (x[used] if used is not None else x).mean(axis=0)


def rotated_about_y(x: np.ndarray, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return x @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])


def superposed(x: np.ndarray, onto: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """x moved and rotated (no reflection) onto another model with least squares over the used particles."""
    used = np.ones(len(x), dtype=bool) if used is None else used
    a, b = x[used].mean(axis=0), onto[used].mean(axis=0)
    u, _, vt = np.linalg.svd((x[used] - a).T @ (onto[used] - b))
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
    return (x - a) @ u @ flip @ vt + b


def angle(a, b, c) -> float:
    """Angle at b in radians."""
    u, v = np.asarray(a) - b, np.asarray(c) - b
    cos = float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)))
    return math.acos(min(1.0, max(-1.0, cos)))


def dihedral(a, b, c, d) -> float:
    """Signed dihedral angle in radians."""
    p, q, r = (np.asarray(y, dtype=float) - x for x, y in ((a, b), (b, c), (c, d)))
    m, n = np.cross(p, q), np.cross(q, r)
    return math.atan2(float(np.linalg.norm(q) * (p @ n)), float(m @ n))


def deviation(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[int, float]:
    """(equivalent positions, rmsd) of two models after superposition."""
    d2 = ((superposed(x, y) - y) ** 2).sum(axis=1)
    return int((d2 < threshold**2).sum()), float(np.sqrt(d2.mean()))


def comparison(x: np.ndarray, y: np.ndarray, threshold: float, used: np.ndarray | None = None) -> tuple[int, float, float]:
    """(equivalent positions, rmsd, distance rmsd) of two models after superposition."""
    used = np.ones(len(x), dtype=bool) if used is None else used
    a, b = superposed(x, y, used)[used], y[used]
    d2 = ((a - b) ** 2).sum(axis=1)
    n, total = len(a), 0.0
    for i in range(0, n, 256):  # rows of the distance matrices that are held at once
        gap = [np.sqrt(((m[i : i + 256, None] - m[None, i:]) ** 2).sum(axis=2)) for m in (a, b)]
        total += float((np.triu(gap[0] - gap[1], 1) ** 2).sum())
    return int((d2 < threshold**2).sum()), float(np.sqrt(d2.mean())), math.sqrt(total / (n * (n - 1) / 2)) if n > 1 else 0.0


#: Particles whose points are looked up at once.
CHUNK = 4000


def accessible(x: np.ndarray, radius: float, super_radius: float, points: int = 100) -> np.ndarray:
    """Share of each particle's sphere of ``radius`` that an object of ``super_radius`` can reach."""
    sphere = sphere_points(points)
    out = np.empty(len(x))
    for i, p in enumerate(x):
        probe = p + sphere * (radius + super_radius)
        d = np.sqrt(((probe[:, None] - np.delete(x, i, axis=0)[None]) ** 2).sum(axis=2))
        out[i] = (d >= radius + super_radius - 1e-9).all(axis=1).mean() if d.size else 1.0
    return out


#: Particles whose points are looked up at once.
CHUNK = 4000


def accessible(x: np.ndarray, radius: float, super_radius: float, points: int = 100, own: np.ndarray | None = None) -> np.ndarray:
    """Share of each particle's sphere of ``radius`` that an object of ``super_radius`` can reach; of the particles ``own``, all by default.

    A point of a sphere is covered by any other particle in its cube, whose diagonal is shorter than the
    sphere's radius; only points in cubes without particles are compared with those of the cubes around.
    """
    own = np.arange(len(x)) if own is None else own
    reach, sphere = radius + super_radius, sphere_points(points)
    if len(x) < 2:
        return np.ones(len(own))
    if np.isnan(x).any():
        return np.zeros(len(own))  # a particle somewhere unknown can cover any other
    side = 0.57 * reach  # the diagonal is 0.987 of the reach
    if not np.isfinite(x).all() or reach <= 1e-6 or not (np.ptp(x, axis=0) / side < 1e6).all():
        away = lambda i: np.sqrt((((x[i] + sphere * reach)[:, None] - np.delete(x, i, axis=0)[None]) ** 2).sum(axis=2))
        return np.array([(away(i) >= reach - 1e-9).all(axis=1).mean() for i in own])
    low = x.min(axis=0) - 4 * side
    spread = (np.floor((x.max(axis=0) - low) / side) + 8).astype(np.int64)
    number = lambda cell: (cell[..., 0] * spread[1] + cell[..., 1]) * spread[2] + cell[..., 2]
    cells = number(np.floor((x - low) / side).astype(np.int64))
    order = np.random.default_rng(0).permutation(len(x))  # covered points meet a particle that covers them early
    order = order[np.argsort(cells[order], kind="stable")]
    taken, first, count = np.unique(cells[order], return_index=True, return_counts=True)
    around = np.stack(np.meshgrid(*[np.arange(-2, 3)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    around = number(around[np.argsort((around**2).sum(axis=1), kind="stable")])  # nearest cubes first
    out = np.empty(len(own))
    for start in range(0, len(own), CHUNK):
        ids = own[start : start + CHUNK]
        probe = (x[ids][:, None] + sphere * reach).reshape(-1, 3)
        home = number(np.floor((probe - low) / side).astype(np.int64))
        at = np.minimum(np.searchsorted(taken, home), len(taken) - 1)
        free = taken[at] != home
        left = np.flatnonzero(free)
        left = left[np.argsort(home[left], kind="stable")]
        for group in np.split(left, np.flatnonzero(np.diff(home[left])) + 1) if len(left) else ():
            near = home[group[0]] + around
            at = np.minimum(np.searchsorted(taken, near), len(taken) - 1)
            at = at[taken[at] == near]
            others = np.concatenate([order[first[k] : first[k] + count[k]] for k in at]) if len(at) else order[:0]
            step, done = 4, 0
            while len(group) and done < len(others):
                some = others[done : done + step]
                d = np.sqrt(((probe[group][:, None] - x[some]) ** 2).sum(axis=2))
                covered = ((d < reach - 1e-9) & (some != ids[group // points][:, None])).any(axis=1)
                free[group[covered]] = False
                group, done = group[~covered], done + step
                step = max(1, min(2 * step, 1_000_000 // max(1, len(group))))
        out[start : start + CHUNK] = free.reshape(-1, points).mean(axis=1)
    return out


def volume(x: np.ndarray, radius: float, grain: float) -> float:
    """Volume within ``radius`` of the chain's particles, by cubes of side ``grain``."""
    low, high = x.min(axis=0) - radius, x.max(axis=0) + radius
    grid = [np.arange(a + grain / 2, b, grain) for a, b in zip(low, high, strict=True)]
    count = 0
    for gx in grid[0]:
        plane = np.stack(np.meshgrid([gx], grid[1], grid[2], indexing="ij"), axis=-1).reshape(-1, 3)
        near = x[np.abs(x[:, 0] - gx) <= radius]
        if len(near):
            count += int((((plane[:, None] - near[None]) ** 2).sum(axis=2) <= radius**2).any(axis=1).sum())
    return count * grain**3


def markov_clusters(weights: np.ndarray, inflation: float = 2.0, rounds: int = 100) -> list[list[int]]:
    """Clusters by alternating expansion and inflation of a column-stochastic matrix."""
    m = weights + np.eye(len(weights)) * weights.max(initial=1.0)
    m = m / m.sum(axis=0)
    for _ in range(rounds):
        before, m = m, np.linalg.matrix_power(m, 2) ** inflation
        m = m / m.sum(axis=0)
        if np.abs(m - before).max() < 1e-9:
            break
    label = m.argmax(axis=0)
    return sorted((np.flatnonzero(label == k).tolist() for k in np.unique(label)), key=lambda c: (-len(c), c))
