"""Numeric kernels for one series or day at a time: small helpers of ``applyInPandas``.

Each takes arrays of one group whose size the caller bounds (a window of minutes,
days of a year), never a table.
"""

from __future__ import annotations

import math

import numpy as np


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Slope, intercept and the 95 % bounds of the slope: medians of pairwise slopes, with Sen's rank interval."""
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    ok = dx != 0
    slopes = np.sort((y[j] - y[i])[ok] / dx[ok])
    if not len(slopes):
        return (np.nan,) * 4
    slope = float(np.median(slopes))
    n = len(x)
    ties = [np.unique(v, return_counts=True)[1] for v in (x, y)]
    variance = (n * (n - 1) * (2 * n + 5) - sum((t * (t - 1) * (2 * t + 5)).sum() for t in ties)) / 18
    half = 1.959963984540054 * np.sqrt(max(variance, 0.0))
    lo, hi = int(np.round((len(slopes) - half) / 2)), int(np.round((len(slopes) + half) / 2))
    return slope, float(np.median(y) - slope * np.median(x)), float(slopes[max(lo - 1, 0)]), float(slopes[min(hi, len(slopes) - 1)])


def change_points(y: np.ndarray, penalty: float, least: int, variance: bool = False) -> list[int]:
    """Ends of the segments (but the last) of least total cost plus ``penalty`` a segment; exact, by
    dynamic programming over all cuts. Cost: squared distance from the mean, or n ln(variance)."""
    n = len(y)
    s, q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for t in range(least, n + 1):
        start = np.arange(0, t - least + 1)
        m = t - start
        square = np.maximum(q[t] - q[start] - (s[t] - s[start]) ** 2 / m, 0)
        cost = m * np.log(np.maximum(square / m, 1e-12)) if variance else square
        total = best[start] + cost + penalty
        k = int(np.argmin(total))
        best[t], last[t] = total[k], start[k]
    cuts, t = [], n
    while t > 0 and np.isfinite(best[t]):
        t = last[t]
        if t:
            cuts.append(int(t))
    return cuts[::-1]


def day_bootstrap(before: np.ndarray, after: np.ndarray, counts_before: np.ndarray, counts_after: np.ndarray, rounds: int, seed: int) -> tuple[float, float, float]:
    """Effect of an intervention and its 95 % interval. Arguments are sums and counts of days by cells.

    Cells that both sides have are compared, weighted by how often they stand
    after; whole days are drawn again, so what hangs together within a day stays so.
    """

    def effect(sb: np.ndarray, cb: np.ndarray, sa: np.ndarray, ca: np.ndarray) -> float:
        ok = (cb > 0) & (ca > 0)
        mb, ma = sb[ok] / cb[ok], sa[ok] / ca[ok]
        base = (ca[ok] * mb).sum()
        return float((ca[ok] * (ma - mb)).sum() / base) if ok.any() and base else np.nan

    rng = np.random.default_rng(seed)
    point = effect(before.sum(0), counts_before.sum(0), after.sum(0), counts_after.sum(0))
    draws = []
    for _ in range(rounds):
        b, a = rng.integers(0, len(before), len(before)), rng.integers(0, len(after), len(after))
        draws.append(effect(before[b].sum(0), counts_before[b].sum(0), after[a].sum(0), counts_after[a].sum(0)))
    lo, hi = np.nanquantile(draws, [0.025, 0.975]) if np.isfinite(draws).any() else (np.nan, np.nan)
    middle, half = (lo + hi) / 2, (hi - lo) / 2 * 1.25
    return point, float(middle - half), float(middle + half)


NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)


def student_t(freedom: np.ndarray, share: float = 0.975) -> np.ndarray:
    """The t below which ``share`` (a half or more) of Student's distribution lies; NaN for fewer than 1 degree of freedom.

    With t = tan(a) sqrt(n), the density becomes cos(a)^(n-1), falling from 0 on, so
    Newton's steps from 0 never pass the solution. Quadrature on 64 nodes; the whole is
    half a beta function, for large n by the series of a quotient of gammas.
    """
    n = np.where(np.asarray(freedom, float) >= 1, np.asarray(freedom, float), np.nan)
    x = n / 2
    quotient = np.sqrt(x) * (1 - 1 / (8 * x) + 1 / (128 * x**2) + 5 / (1024 * x**3) - 21 / (32768 * x**4))
    small = np.array([math.exp(math.lgamma(v + 0.5) - math.lgamma(v)) if v < 500 else np.nan for v in x])
    goal = (share - 0.5) * math.sqrt(math.pi) / np.where(x < 500, small, quotient)
    angle = np.zeros_like(n)
    for _ in range(60):
        held = angle / 2 * (np.cos(np.multiply.outer(NODES + 1, angle / 2)) ** (n - 1) * WEIGHTS[:, None]).sum(0)
        step = (goal - held) / np.cos(angle) ** (n - 1)
        angle = angle + step
        if not (np.abs(step) > 1e-15 * angle).any():
            break
    return np.tan(angle) * np.sqrt(n)


def air_changes(hours: np.ndarray, ppm: np.ndarray, outdoor: float = 420.0) -> dict:
    """Air changes an hour from the decay of CO2: the falling stretch of best fit of ln(ppm - outdoor).

    A stretch lasts half an hour or more, starts 200 ppm above outdoors and fits
    with R2 of 0.8 or more; else the reason why there is none.
    """
    if len(ppm) < 3:
        return {"reason": "NO_DATA"}
    smooth = np.array([np.median(ppm[max(0, i - 1) : i + 2]) for i in range(len(ppm))])
    noise = 1.4826 * np.median(np.abs(np.diff(ppm) - np.median(np.diff(ppm)))) / np.sqrt(2)
    slack = max(10.0, 5 * noise * 1.2 / np.sqrt(3))
    segments, start, low = [], 0, smooth[0]
    for i in range(1, len(smooth)):
        if smooth[i] > low + slack or smooth[i] < outdoor + 50:
            segments.append((start, i))
            start, low = i, smooth[i]
        low = min(low, smooth[i])
        if smooth[i] >= smooth[start]:
            start, low = i, smooth[i]
    segments.append((start, len(smooth)))
    best, reasons = None, set()
    for a, b in segments:
        if b - a < 3:
            continue
        if hours[b - 1] - hours[a] < 0.5:
            reasons.add("TOO_SHORT")
            continue
        if smooth[a] - outdoor < 200:
            reasons.add("LOW_AMPLITUDE")
            continue
        x, y = hours[a:b] - hours[a], np.log(np.maximum(ppm[a:b] - outdoor, 1.0))
        sxx, syy, sxy = ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()
        slope, r2 = sxy / sxx, (sxy * sxy / (sxx * syy) if syy else 0.0)
        if slope >= 0 or round(r2, 4) < 0.8:
            reasons.add("LOW_FIT")
            continue
        error = np.sqrt(max(1 - r2, 0) * syy / sxx / max(b - a - 2, 1)) * student_t(np.array([max(b - a - 2, 1)]))[0]
        if best is None or round(r2, 4) > best["r2"]:
            best = {"ach": -slope, "ci_low": -slope - error, "ci_high": -slope + error, "r2": round(float(r2), 4), "start": a, "end": b - 1}
    if best:
        return best
    return {"reason": next((r for r in ("LOW_FIT", "TOO_SHORT", "LOW_AMPLITUDE") if r in reasons), "NO_DATA")}


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = labels[:, None] == labels[None]
    size = own.sum(1)
    a = np.where(size > 1, (d * own).sum(1) / np.maximum(size - 1, 1), 0)
    b = np.min([np.where(labels == k, np.inf, d[:, labels == k].mean(1)) for k in np.unique(labels)], 0)
    return float(np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
        for _ in range(100):
            label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[label == i].mean(0) if (label == i).any() else centre[i] for i in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = ((x - centre[label]) ** 2).sum()
        if cost < best[0]:
            best = (cost, label)
    return best[1]


def profile_clusters(x: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, float]:
    """Labels of days' profiles, numbered by first appearance, and their silhouette. Of cluster counts whose
    silhouette is near the best (0.15) and 0.5 or more the largest; else that of the best."""
    scale = x.std() or 1.0
    z, options = x / scale, []
    for k in range(2, min(most, max(2, len(x) // 4)) + 1):
        label = kmeans(z, k, seed)
        if len(np.unique(label)) > 1:
            options.append((k, silhouette(z, label), label))
    if not options:
        return np.zeros(len(x), int), 0.0
    top = max(s for _, s, _ in options)
    near = [o for o in options if o[1] >= max(0.5, top - 0.15)]
    _, score, label = max(near, key=lambda o: o[0]) if near else max(options, key=lambda o: o[1])
    names = {v: i for i, v in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([names[v] for v in label.tolist()]), score


def holt_winters(y: np.ndarray, period: int, horizon: int) -> np.ndarray:
    """Additive seasonal smoothing without trend (damped trend without season), its weights by least one-step error."""
    if len(y) < 2 * period or period < 2:
        period = 0
    season0 = np.array([y[i::period].mean() for i in range(period)]) - y.mean() if period else np.zeros(1)

    def run(alpha: float, gamma: float, beta: float = 0.0, phi: float = 0.9) -> tuple[float, np.ndarray]:
        level, trend, season, error = (y[:period].mean() if period else y[0]), 0.0, season0.copy(), 0.0
        for i, v in enumerate(y):
            k = i % period if period else 0
            fitted = level + phi * trend + season[k]
            e = v - fitted
            error += e * e
            old = level
            level += phi * trend + alpha * e
            trend = phi * trend + beta * e if not period else 0.0
            if period:
                season[k] += gamma * e
            del old
        steps = np.arange(len(y), len(y) + horizon)
        if period:
            return error, level + season[steps % period]
        damp = np.cumsum(phi ** np.arange(1, horizon + 1))
        return error, level + damp * trend

    grid = [(a, g, 0.0) for a in (0.02, 0.1, 0.3, 0.6, 0.9) for g in (0.01, 0.1, 0.3)] if period else [(a, 0.0, b) for a in (0.1, 0.3, 0.6, 0.9) for b in (0.0, 0.05, 0.2)]
    return min((run(a, g, b) for a, g, b in grid), key=lambda r: r[0])[1]


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Isolation forest: mean depth at which random cuts part a row from a sample, as a score of 0 to 1."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    most = int(np.ceil(np.log2(max(size, 2))))

    def usual(m: float) -> float:
        return 0.0 if m <= 1 else 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m if m > 2 else 1.0

    depth = np.zeros(n)
    for _ in range(trees):
        todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while todo:
            mine, rows, d = todo.pop()
            if not len(rows):
                continue
            spread = np.ptp(x[mine], 0) if len(mine) > 1 else np.zeros(x.shape[1])
            if d >= most or len(mine) <= 1 or not spread.any():
                depth[rows] += d + usual(len(mine))
                continue
            f = rng.choice(np.flatnonzero(spread))
            at = rng.uniform(x[mine, f].min(), x[mine, f].max())
            todo.append((mine[x[mine, f] < at], rows[x[rows, f] < at], d + 1))
            todo.append((mine[x[mine, f] >= at], rows[x[rows, f] >= at], d + 1))
    return 2 ** (-depth / trees / max(usual(size), 1e-9))


def seasonal_regression(y: np.ndarray, period: int, horizon: int, x: np.ndarray | None = None, x_next: np.ndarray | None = None) -> np.ndarray:
    """Level, harmonics of the season and covariates by least squares, whose residuals follow an ARMA(1, 1);
    weights of the residuals by least one-step error (conditional sum of squares)."""
    n = len(y)
    t = np.arange(n + horizon)
    waves = [f(2 * np.pi * k * t / period) for k in range(1, min(4, period // 2) + 1) for f in (np.sin, np.cos)] if period >= 2 and n >= 2 * period else []
    design = np.stack([np.ones(n + horizon), *waves], 1)
    if x is not None and x_next is not None:
        design = np.hstack([design, np.vstack([x, x_next])])
    beta = np.linalg.lstsq(design[:n], y, rcond=None)[0]
    rest = y - design[:n] @ beta

    def errors(phi: float, theta: float) -> tuple[float, float]:
        e, total = 0.0, 0.0
        for i in range(1, n):
            e = rest[i] - phi * rest[i - 1] - theta * e
            total += e * e
        return total, e

    grid = [(p, q) for p in (0.0, 0.3, 0.6, 0.8, 0.95) for q in (-0.4, 0.0, 0.4)]
    phi, theta = min(grid, key=lambda g: errors(*g)[0])
    step, out = phi * rest[-1] + theta * errors(phi, theta)[1], []
    for _ in range(horizon):
        out.append(step)
        step *= phi
    return design[n:] @ beta + np.array(out)


class BoostedTrees:
    """Least-squares boosting of trees of two levels over quantile cuts."""

    def __init__(self, rounds: int = 100, rate: float = 0.05, cuts: int = 16):
        self.rounds, self.rate, self.cuts, self.trees, self.base = rounds, rate, cuts, [], 0.0

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best = (1e-12, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            at = np.unique(np.linspace(1, len(y) - 1, self.cuts + 1).astype(int)) if len(y) > 2 else np.empty(0, int)
            at = at[v[at] != v[at - 1]] if len(at) else at
            if len(at):
                left = s[at - 1]
                gain = left**2 / at + (s[-1] - left) ** 2 / (len(y) - at) - s[-1] ** 2 / len(y)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, (v[at[k]] + v[at[k] - 1]) / 2))
        return best[1]

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
        cut = self._split(x, y) if depth and len(y) >= 10 else None
        if cut is None:
            return float(y.mean())
        low = x[:, cut[0]] < cut[1]
        return (*cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def _value(self, tree: tuple | float, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, at, low, high = tree
        return np.where(x[:, f] < at, self._value(low, x), self._value(high, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(y.mean())
        rest = y - self.base
        for _ in range(self.rounds):
            tree = self._grow(x, rest, 2)
            self.trees.append(tree)
            rest = rest - self.rate * self._value(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))


def boosted_forecast(y: np.ndarray, period: int, horizon: int) -> np.ndarray:
    """Boosted trees on lags 1, 2, 3, one and two periods and the place in the period, fed with their own forecasts."""
    lags = sorted({k for k in (1, 2, 3, period, 2 * period) if 0 < k < len(y) // 2})
    if not lags:
        return np.full(horizon, y.mean())
    most = max(lags)
    place = np.arange(len(y) + horizon) % max(period, 1)
    x = np.stack([*(y[most - k : len(y) - k] for k in lags), place[most : len(y)]], 1)
    model, known = BoostedTrees().fit(x, y[most:]), list(y)
    for h in range(horizon):
        row = np.array([[*(known[-k] for k in lags), place[len(y) + h]]])
        known.append(float(model.predict(row)[0]))
    return np.array(known[len(y) :])


FORECASTS = {"HOLT_WINTERS": holt_winters, "SARIMAX": seasonal_regression, "GRADIENT_BOOSTING": boosted_forecast}


def best_period(y: np.ndarray) -> int:
    """A week of hours unless a day forecasts clearly better on the last fifth (0 without two days)."""
    held = max(1, len(y) // 5)
    score = {}
    for p in (24, 168):
        if len(y) - held >= 2 * p:
            out = holt_winters(y[:-held], p, held)
            score[p] = np.mean(np.abs(out - y[-held:]) / np.maximum(np.abs(y[-held:]), 1e-9))
    if not score:
        return 0
    return 24 if 168 not in score or score.get(24, np.inf) < 0.85 * score[168] else 168
