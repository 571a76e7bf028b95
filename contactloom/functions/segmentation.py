"""Numeric kernels on one chromosome's dense map."""

from __future__ import annotations

import math

import numpy as np

from contactloom.functions.linear import ranks


def borders_from_insulation(score: list, delta: list, min_strength: float = 0.1) -> list[tuple[int, float]]:
    """(position, strength) of local minima where the delta turns from positive to negative.

    The strength is a sigmoid of the difference between the delta's peak on the
    left and its trough on the right.
    """
    out = []
    for x in range(1, len(score) - 1):
        around = (score[x - 1], score[x], score[x + 1], delta[x - 1], delta[x + 1])
        if any(v is None or v != v for v in around):
            continue
        if not (score[x] < score[x - 1] and score[x] < score[x + 1] and delta[x - 1] > 0 > delta[x + 1]):
            continue
        left, right = x - 1, x + 1
        while left > 0 and delta[left - 1] is not None and delta[left - 1] >= delta[left]:
            left -= 1
        while right < len(delta) - 1 and delta[right + 1] is not None and delta[right + 1] <= delta[right]:
            right += 1
        strength = 2 / (1 + math.exp(-(delta[left] - delta[right]))) - 1
        if strength > min_strength:
            out.append((x, strength))
    return out


# --- window-based domains -----------------------------------------------------


def diamond(m: np.ndarray, i: int, w: int) -> np.ndarray:
    """Contacts between the w bins up to i and the w bins after it."""
    return m[max(0, i - w + 1) : i + 1, i + 1 : min(len(m), i + 1 + w)]


def rank_sum_less(a: np.ndarray, b: np.ndarray) -> float:
    """One-sided p that ``a`` tends to be less than ``b``: normal approximation with tie and continuity corrections."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0
    joined = np.r_[a, b]
    u = ranks(joined)[:n].sum() - n * (n + 1) / 2
    counts = np.unique(joined, return_counts=True)[1].astype(float)
    total = n + m
    var = n * m / 12 * (total + 1 - (counts**3 - counts).sum() / (total * (total - 1)))
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc(-((u - n * m / 2 + 0.5) / math.sqrt(var)) / math.sqrt(2))


def _bends(z: np.ndarray) -> list[int]:
    """Places where a polyline of complex points is cut into chords.

    From each cut the chord is lengthened point by point while its merit does not fall:
    its length less the distances of the points that it passes by.
    """
    cuts, last = [0], len(z) - 1
    while cuts[-1] < last:
        here = cuts[-1]
        merit, end = -math.inf, last
        for j in range(here + 1, len(z)):
            chord = z[j] - z[here]
            passed = (np.conj(chord / abs(chord)) * (z[here + 1 : j] - z[here])).imag
            following = abs(chord) - np.abs(passed).sum()
            if following < merit:
                end = j - 1
                break
            merit = following
        cuts.append(end)
    return cuts


def turning_points(x: np.ndarray) -> tuple[list[int], list[int]]:
    """(minima, maxima) of a curve, from its cuts into chords in units of its mean steps.

    A cut is an extreme if it is one among its adjacent points; a stretch between cuts,
    except the last, adds the points that lie below or above both of its ends.
    """
    x = np.nan_to_num(np.asarray(x, dtype=float))
    n = len(x)
    if n <= 3:
        return ([int(x.argmin())], [int(x.argmax())]) if n else ([], [])
    y = x / (np.abs(np.diff(x)).mean() or 1.0)
    cuts = _bends(np.arange(n) + 1j * y)
    low, high = set(), set()
    for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
        beside = y[[b - 1, b + 1]]
        if (y[b] >= beside).all():
            high.add(b)
        elif (y[b] < beside).all():
            low.add(b)
        stretch = y[a : b + 1]
        for found, other, at, beyond in ((low, high, stretch.argmin(), stretch.min() < min(y[a], y[b])), (high, low, stretch.argmax(), stretch.max() > max(y[a], y[b]))):
            if beyond:
                found.add(a + int(at))
                other.discard(a + int(at))
    return sorted(low), sorted(high)


def gap_bins(m: np.ndarray) -> np.ndarray:
    """Bins of runs of two or more bins without a contact among themselves, taken greedily from the left."""
    n = len(m)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = np.cumsum(np.cumsum(m, axis=0), axis=1)
    inside = lambda a, b: area[b, b] - area[a, b] - area[b, a] + area[a, a]
    gap, a = np.zeros(n, dtype=bool), 0
    while a < n:
        b = a + 1
        while b < n and inside(a, b + 1) == 0:
            b += 1
        gap[a:b] |= b - a > 1
        a = b
    return gap


def regions(gap: np.ndarray, least: int = 4) -> list[tuple[int, int]]:
    """Half-open runs of at least ``least`` bins without a gap."""
    edge = np.flatnonzero(np.diff(np.r_[1, gap.astype(int), 1]))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def border_test(scaled: np.ndarray, i: int, w: int) -> float:
    """p that contacts across the border after bin i are fewer than those within the w + 1 bins before and the w bins behind it."""
    inner = []
    for lo, hi in ((max(0, i - w), i + 1), (i + 1, min(len(scaled), i + 1 + w))):
        block = scaled[lo:hi, lo:hi]
        inner.append(block[np.triu_indices(len(block), 1)])
    inner = np.concatenate(inner)
    return rank_sum_less(diamond(scaled, i, w).ravel(), inner[inner != 0])


def window_domains(m: np.ndarray, w: int, test: bool = True, cut: float = 0.05) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of domains, boundaries and gaps by diamond means of size w.

    Borders are the minima of the diamond means between gaps, with ``test`` those that the
    rank test confirms.  A domain ends with its border; its score is the mean p of its
    bins, and if all of them are below ``cut`` it is a boundary.  Borders side by side are
    a boundary of their own.  Gaps and boundaries score 0.
    """
    n = len(m)
    mean = np.array([d.mean() if (d := diamond(m, i, w)).size else 0.0 for i in range(n)])
    gap = gap_bins(m)
    border, p = np.zeros(n, dtype=bool), np.ones(n)
    scaled = np.triu(m).astype(float)
    for k in range(1, min(2 * w, n)):
        d = np.diagonal(m, k).astype(float)
        sd = d.std(ddof=1) if len(d) > 1 else 0.0
        scaled[np.arange(n - k), np.arange(k, n)] = (d - d.mean()) / sd if sd > 0 else 0.0
    for a, b in regions(gap):
        if test:
            p[a : b - 1] = [border_test(scaled[a:b, a:b], k, w) for k in range(b - a - 1)]
        border[[a + x for x in turning_points(mean[a:b])[0]]] = True
    border &= (p < cut) if test else True
    out: list[tuple[int, int, str, float]] = []
    for a, b in regions(~gap, 1):
        out.append((a, b - 1, "gap", 0.0))
    for a, b in regions(~border, 2):
        out.append((a, b - 1, "boundary", 0.0))
    for a, b in regions(gap | border, 1):
        own = p[a:b]
        kind = "boundary" if test and (own < cut).all() else "domain"
        alone = b < n and border[b] and not (b + 1 < n and border[b + 1])
        out.append((a, b - 1 + alone, kind, float(own.mean()) if test else 0.0))
    return sorted(out)


# --- likelihood-based domains ---------------------------------------------------


def _fit_many(k: np.ndarray, w: np.ndarray, logd: np.ndarray) -> np.ndarray:
    """Poisson log-likelihoods, one a row, of totals per distance."""
    return fit_totals(k.sum(axis=1), (k * logd).sum(axis=1), w, logd)


def fit_totals(total: np.ndarray, moment: np.ndarray, w: np.ndarray, logd: np.ndarray) -> np.ndarray:
    """Poisson log-likelihoods, one a row, of blocks with mean w * exp(a + b * log distance), fitted by damped Newton steps.

    Of a block's contacts only their sum and the sum of their log distances matter; the
    weights are totals per distance.
    """
    weight = w.sum(axis=1)
    out = np.zeros(len(w))
    fit = np.flatnonzero((total > 0) & (weight > 0))
    if not len(fit):
        return out
    w = w[fit]
    a, b = np.log(total[fit] / weight[fit]), np.zeros(len(fit))
    kd, k0 = moment[fit], total[fit]

    def value(a, b, rows):
        lam = w[rows] * np.exp(np.clip(a[:, None] + b[:, None] * logd, -50, 50))
        return k0[rows] * a + kd[rows] * b - lam.sum(axis=1), lam

    live = np.arange(len(fit))
    best, lam = value(a, b, live)
    for _ in range(60):
        s0, s1, s2 = lam.sum(axis=1), (lam * logd).sum(axis=1), (lam * logd * logd).sum(axis=1)
        g0, g1 = k0[live] - s0, kd[live] - s1
        det = s0 * s2 - s1 * s1
        flat = det <= 1e-9 * s0 * s2 + 1e-300  # one distance only: the level alone can be fitted
        safe = np.where(flat, 1.0, det)
        da = np.where(flat, g0 / np.maximum(s0, 1e-300), (s2 * g0 - s1 * g1) / safe)
        db = np.where(flat, 0.0, (s0 * g1 - s1 * g0) / safe)
        scale = np.ones(len(live))
        for _ in range(30):
            after, lam = value(a[live] + scale * da, b[live] + scale * db, live)
            worse = ~(after >= best[live])
            if not worse.any():
                break
            scale[worse] /= 2
        better = after >= best[live]
        gain = np.where(better, after - best[live], 0.0)
        a[live[better]] += (scale * da)[better]
        b[live[better]] += (scale * db)[better]
        best[live] += gain
        go = gain >= 1e-6
        live = live[go]
        if not len(live):
            break
        lam = lam[go]
    out[fit] = best
    return out


class Diagonals:
    """Running sums of a map and of its weights along every diagonal: totals per distance of any block in one look-up each."""

    def __init__(self, m: np.ndarray):
        n = len(m)
        sums = m.sum(axis=0).astype(float)
        self.n, self.logd = n, np.log(np.arange(1, max(n, 2)))
        self.k, self.w = np.zeros((max(n - 1, 1), n + 1)), np.zeros((max(n - 1, 1), n + 1))
        for d in range(1, n):
            self.k[d - 1, 1 : n - d + 1] = np.cumsum(np.diagonal(m, d))
            self.w[d - 1, 1 : n - d + 1] = np.cumsum(sums[: n - d] * sums[d:])
            self.k[d - 1, n - d + 1 :], self.w[d - 1, n - d + 1 :] = self.k[d - 1, n - d], self.w[d - 1, n - d]

    def totals(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the cells (x, x + d) with first <= x < end, for every row of bounds and every distance d (a column)."""
        d = np.arange(first.shape[1])
        end = np.maximum(end, first)
        return self.k[d, end] - self.k[d, first], self.w[d, end] - self.w[d, first]

    def segments(self, i: int, ends: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the segments from bin i to each end: the own block plus half of the blocks with what is before and after."""
        n, d = self.n, np.arange(1, self.n)
        j = ends[:, None]
        longest = int(ends.max()) - i
        near = d[:longest][None, :]
        value = _fit_many(*self.totals(np.full((len(ends), longest), i), np.clip(j + 1 - near, i, n)), self.logd[:longest])
        if i:
            reach = d[: int(ends.max())][None, :]  # x < i <= x + d <= j
            first, end = np.maximum(0, i - reach) + 0 * j, np.minimum(i, j + 1 - reach)
            value += 0.5 * _fit_many(*self.totals(first, end), self.logd[: reach.shape[1]])
        reach = d[: n - 1 - i][None, :]  # i <= x <= j < x + d
        if reach.size:
            first, end = np.maximum(i, j + 1 - reach), np.minimum(j + 1, n - reach)
            value += 0.5 * _fit_many(*self.totals(first, end), self.logd[: reach.shape[1]])
        return value


def segment_likelihoods(m: np.ndarray, least: int = 5, longest: int | None = None, starts=None) -> np.ndarray:
    """ll[i, j - i]: log-likelihood of the segment of bins i..j of at most ``longest`` bins; -inf where it is shorter than ``least``, or not asked for."""
    n = len(m)
    longest = min(longest or n, n)
    ll = np.full((n, longest), -np.inf)
    sums = Diagonals(m)
    for i in range(n) if starts is None else starts:
        ends = np.arange(i + least - 1, min(n, i + longest))
        if len(ends):
            ll[i, ends - i] = sums.segments(i, ends)
    return ll


def optimal_breaks(ll: np.ndarray, samples: int = 1, most: int | None = None) -> list[int]:
    """Ends of the segments that maximise the likelihood under the penalty breaks + samples * (8 + 6 * breaks)."""
    n, longest = ll.shape
    most = most if most is not None else max(n // 5, 1)
    # by_end[e, l]: the segment of l + 1 bins that ends at e; prior[e, l]: the end before it.
    e, l = np.arange(n)[:, None], np.arange(longest)[None, :]
    start = e - l
    by_end = np.where(start >= 0, ll[np.maximum(start, 0), l], -np.inf)
    best = np.where(np.arange(n) < longest, ll[0, np.minimum(np.arange(n), longest - 1)], -np.inf)
    penalty = lambda nb: nb + samples * (8 + 6 * nb)
    scores, back = [best[n - 1] - penalty(0)], []
    for nb in range(1, most + 1):
        options = by_end + np.where(start >= 1, best[np.maximum(start - 1, 0)], -np.inf)
        size = options.argmax(axis=1)
        best = options[np.arange(n), size]
        back.append(np.arange(n) - size - 1)
        scores.append(best[n - 1] - penalty(nb))
        if not np.isfinite(best).any():
            break
    nb = int(np.argmax(scores))
    ends, x = [n - 1], n - 1
    for k in range(nb, 0, -1):
        x = int(back[k - 1][x])
        ends.append(x)
    return ends[::-1]


def scored_breaks(ll: np.ndarray, samples: int = 1, rounds: int = 10) -> list[tuple[int, int | None]]:
    """(end, score) of the optimal segments; a score counts in how many further runs, each penalising the segments used before by 6 per sample, the border survives."""
    ends = optimal_breaks(ll, samples)
    count = dict.fromkeys(ends[:-1], 0)
    penalised, current = ll.copy(), ends
    for _ in range(rounds):
        start = 0
        for e in current:
            penalised[start, e - start] -= 6 * samples
            start = e + 1
        current = optimal_breaks(penalised, samples)
        for e in set(count).intersection(current[:-1]):
            count[e] += 1
    return [(e, count.get(e)) for e in ends]


def kept_domains(scored: list[tuple[int, int | None]], keep: np.ndarray, n: int) -> list[tuple[int, int, float | None]]:
    """(start, end, score) on the full map of segments of its kept bins."""
    out, start = [], 0
    for e, score in scored:
        end = n - 1 if e == len(keep) - 1 else int(keep[e])
        out.append((start, end, None if score is None else float(score)))
        start = end + 1
    return out


def likelihood_domains(maps: list[np.ndarray], removed: np.ndarray | None = None, rounds: int = 10, longest: int | None = None) -> list[tuple[int, int, float | None]]:
    """(start, end, score) of the domains of one or more maps of the same bins."""
    n = len(maps[0])
    keep = np.flatnonzero(~removed) if removed is not None else np.arange(n)
    if len(keep) < 5:
        return [(0, n - 1, None)] if n else []
    ll = sum(segment_likelihoods(m[np.ix_(keep, keep)].astype(float), longest=longest) for m in maps)
    return kept_domains(scored_breaks(ll, len(maps), rounds), keep, n)


# --- the same likelihood from a chromosome's row sums only ------------------------


def lag_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of a[x] * b[y] for every distance 1, 2, ... of x and y, where b follows a without a gap."""
    if min(len(a), len(b)) <= 32:
        return np.convolve(a[::-1], b)
    size = 1 << (len(a) + len(b) - 2).bit_length()
    product = np.fft.irfft(np.fft.rfft(a[::-1], size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1]
    # Rounding leaves distances without weight a little above or below zero.
    return np.where(product > 1e-13 * product.max(initial=0.0), product, 0.0)


def own_products(a: np.ndarray) -> np.ndarray:
    """Sum of a[x] * a[x + d] for d = 1 .. len(a) - 1."""
    return lag_products(a, a)[len(a) :] if len(a) > 1 else np.zeros(0)


def segment_fits(sums: np.ndarray, first: int, ends: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, at_once: int = 2_000_000) -> np.ndarray:
    """Log-likelihoods of the segments [first, end): the own block plus half of the blocks with what is before and after.

    ``own``, ``before`` and ``after`` have two columns, contacts and their summed log
    distances; ``sums`` are the row sums of the chromosome.
    """
    n = len(sums)
    logd = np.log(np.arange(1, max(n, 2)))
    out = np.zeros(len(ends))
    block = max(1, at_once // max(n, 1))
    for lo in range(0, len(ends), block):
        part = slice(lo, lo + block)
        for share, stats, products in (
            (1.0, own[part], [own_products(sums[first:e]) for e in ends[part]]),
            (0.5, before[part], [lag_products(sums[:first], sums[first:e]) if first else np.zeros(0) for e in ends[part]]),
            (0.5, after[part], [lag_products(sums[first:e], sums[e:]) if e < n else np.zeros(0) for e in ends[part]]),
        ):
            width = max(map(len, products))
            if width:
                w = np.stack([np.pad(p, (0, width - len(p))) for p in products])
                out[part] += share * fit_totals(stats[:, 0], stats[:, 1], w, logd[:width])
    return out


def inner_totals(band: np.ndarray) -> np.ndarray:
    """t[p, h]: total of the blocks (a, b) with p <= a <= b <= p + h, from band[a, b - a]."""
    out, column = band.copy(), band[:, 0].copy()
    for h in range(1, band.shape[1]):
        # column[p]: total of the blocks (a, p + h) with a >= p.
        column = np.r_[column[1:], 0.0] + band[:, h]
        out[:, h] = out[:, h - 1] + column
    return out


def best_path(first: np.ndarray, end: np.ndarray, value: np.ndarray, last: int, samples: int = 1) -> list[int]:
    """Indices of the segments from 0 to ``last`` of the greatest total, less 1 + 6 * samples for every border."""
    best, via = {0: 1.0 + 6.0 * samples}, {}
    for e in np.argsort(end, kind="stable"):
        start = best.get(int(first[e]))
        if start is not None:
            total = start + value[e] - (1 + 6 * samples)
            if total > best.get(int(end[e]), -np.inf):
                best[int(end[e])], via[int(end[e])] = total, int(e)
    path, x = [], last
    while x > 0:
        if x not in via:
            raise ValueError("no segments lead through the chromosome: the longest domain allowed is too short")
        path.append(via[x])
        x = int(first[via[x]])
    return path[::-1]


def scored_path(first: np.ndarray, end: np.ndarray, value: np.ndarray, last: int, samples: int = 1, rounds: int = 10) -> list[tuple[int, int | None]]:
    """(last bin, score) of the best segments; scores as in ``scored_breaks``."""
    path = best_path(first, end, value, last, samples)
    ends = [int(end[e]) - 1 for e in path]
    count, penalised = dict.fromkeys(ends[:-1], 0), value.copy()
    for _ in range(rounds):
        penalised[path] -= 6 * samples
        path = best_path(first, end, penalised, last, samples)
        for e in set(count).intersection([int(end[x]) - 1 for x in path[:-1]]):
            count[e] += 1
    return [(e, count.get(e)) for e in ends]


def next_places(borders: np.ndarray, step: int, inner: int = 12, reach: int = 4) -> np.ndarray:
    """Candidate borders: the accepted ones, places around them at ``step`` and an even grid inside every segment."""
    near = borders[:, None] + step * np.arange(-reach, reach + 1)[None, :]
    grid = [np.linspace(a, b, inner + 2).astype(int) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    every = np.unique(np.concatenate([near.ravel(), *grid]))
    return every[(every >= 0) & (every <= borders[-1])]


# --- borders of several experiments ------------------------------------------


def reciprocal_matches(a: list[float], b: list[float], max_dist: float) -> tuple[list[tuple[float | None, float | None]], float]:
    """Borders matched with their mutually nearest ones, in order, and the alignment's score."""
    nearest = lambda x, ys, lo: min(range(lo, len(ys)), key=lambda k: (abs(ys[k] - x), k), default=None)
    out: list[tuple[float | None, float | None]] = []
    diffs, i, j = [], 0, 0
    for k, x in enumerate(a):
        at = nearest(x, b, j)
        if at is None or nearest(b[at], a, i) != k or abs(b[at] - x) > max_dist:
            continue
        out.extend((y, None) for y in a[i:k])
        out.extend((None, y) for y in b[j:at])
        out.append((x, b[at]))
        diffs.append(abs(b[at] - x))
        i, j = k + 1, at + 1
    out.extend((y, None) for y in a[i:])
    out.extend((None, y) for y in b[j:])
    penalty = 2 * max_dist
    if not out:
        return out, 1.0
    return out, 1 - (penalty * (len(out) - len(diffs)) + sum(diffs)) / len(out) / penalty


def global_alignment(a: list[float], b: list[float], gap: float = -6.0, extend: float = -5.6, max_dist: float = 500_000):
    """Global alignment of borders: score log(1 / (distance + 1)), affine gaps: (pairs, score)."""
    n, m = len(a), len(b)
    score = np.full((3, n + 1, m + 1), -np.inf)
    back = np.zeros((3, n + 1, m + 1), dtype=int)
    score[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                d = abs(a[i - 1] - b[j - 1])
                if d <= max_dist:
                    s = score[:, i - 1, j - 1]
                    back[0, i, j] = int(s.argmax())
                    score[0, i, j] = s.max() + math.log(1 / (d + 1))
            for state, (di, dj) in ((1, (1, 0)), (2, (0, 1))):
                if i >= di and j >= dj:
                    s = score[:, i - di, j - dj] + np.where(np.arange(3) == state, extend, gap)
                    back[state, i, j] = int(s.argmax())
                    score[state, i, j] = s.max()
    i, j, state, out = n, m, int(score[:, n, m].argmax()), []
    total = float(score[:, n, m].max())
    while i or j:
        following = back[state, i, j]
        if state == 0:
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif state == 1:
            out.append((a[i - 1], None))
            i -= 1
        else:
            out.append((None, b[j - 1]))
            j -= 1
        state = following
    return out[::-1], total


def consensus(pairs: list[tuple[float | None, float | None]], passed: int) -> list[float]:
    """Running mean of aligned borders after ``passed`` experiments."""
    return [y if x is None else x if y is None else (x * passed + y) / (passed + 1) for x, y in pairs]


def progressive(experiments: list[list[float]], method: str = "reciprocal", **options) -> tuple[list[list[float | None]], float]:
    """Alignment of many experiments on their consensus, the most bordered first: (rows, mean score)."""
    order = sorted(range(len(experiments)), key=lambda k: -len(experiments[k]))
    align = {"reciprocal": reciprocal_matches, "global": global_alignment}[method]
    common = list(experiments[order[0]])
    rows = {order[0]: list(common)}
    scores = []
    for passed, k in enumerate(order[1:], 1):
        pairs, score = align(common, experiments[k], **options)
        scores.append(score)
        at = 0
        places = []
        for x, _ in pairs:
            places.append(at if x is not None else None)
            at += x is not None
        for done in rows:
            rows[done] = [rows[done][p] if p is not None else None for p in places]
        rows[k] = [y for _, y in pairs]
        common = consensus(pairs, passed)
    return [rows[k] for k in range(len(experiments))], float(np.mean(scores)) if scores else 1.0


def overlap_alignment(a: np.ndarray, b: np.ndarray, vectors: int = 3, gap: float = 0.0) -> tuple[list[tuple[int | None, int | None]], float]:
    """Contact-map overlap: rows aligned by weighted leading eigenvectors under the best sign choice; score is the rank correlation."""
    from itertools import product

    from contactloom.functions.linear import spearman

    def scaled(m):
        values, v = np.linalg.eigh((m + m.T) / 2)
        order = np.argsort(-np.abs(values))[:vectors]
        return v[:, order] * np.sqrt(np.abs(values[order]))

    va, vb = scaled(a), scaled(b)
    k = min(va.shape[1], vb.shape[1])
    best = (None, -math.inf)
    for signs in product((1, -1), repeat=k):
        s = (va[:, :k] * np.array(signs)) @ vb[:, :k].T
        n, m = s.shape
        t = np.zeros((n + 1, m + 1))
        t[1:, 0], t[0, 1:] = np.arange(1, n + 1) * gap, np.arange(1, m + 1) * gap
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                t[i, j] = max(t[i - 1, j - 1] + s[i - 1, j - 1], t[i - 1, j] + gap, t[i, j - 1] + gap)
        i, j, pairs = n, m, []
        while i and j:
            if t[i, j] == t[i - 1, j - 1] + s[i - 1, j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif t[i, j] == t[i - 1, j] + gap:
                pairs.append((i - 1, None))
                i -= 1
            else:
                pairs.append((None, j - 1))
                j -= 1
        pairs.extend((x, None) for x in range(i - 1, -1, -1))
        pairs.extend((None, y) for y in range(j - 1, -1, -1))
        pairs.reverse()
        both = [(x, y) for x, y in pairs if x is not None and y is not None]
        xs, ys = [x for x, _ in both], [y for _, y in both]
        if len(both) < 3:
            continue
        score = spearman(a[np.ix_(xs, xs)].ravel(), b[np.ix_(ys, ys)].ravel())
        if score == score and score > best[1]:
            best = (pairs, score)
    return best[0] or [], float(best[1]) if best[0] else float("nan")


def merged_overlap(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int | None, int | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both maps on the rows of their alignment and the mean of both; not a number where a map has no row."""

    def spread(m: np.ndarray, rows: list[int | None]) -> np.ndarray:
        at = np.array([k for k, r in enumerate(rows) if r is not None], dtype=int)
        used = np.array([r for r in rows if r is not None], dtype=int)
        out = np.full((len(rows), len(rows)), np.nan)
        out[np.ix_(at, at)] = m[np.ix_(used, used)]
        return out

    first, second = spread(a, [x for x, _ in pairs]), spread(b, [y for _, y in pairs])
    return first, second, (first + second) / 2
