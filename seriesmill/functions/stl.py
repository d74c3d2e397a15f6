"""Seasonal-trend decomposition by loess (Cleveland et al., 1990) for a periodic season, in NumPy."""

from __future__ import annotations

import numpy as np


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def loess(y: np.ndarray, q: int, degree: int, weight: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Local fits of a constant or a line with tricube weights over the q nearest points, at 1..n or ``at``."""
    n = len(y)
    x = np.arange(1.0, n + 1)
    at = x if at is None else at
    k = min(q, n)
    out = np.empty(len(at))
    for i, t in enumerate(at):
        left = int(np.clip(np.ceil(t - (k + 1) / 2), 0, n - k))
        while left + k < n and x[left + k] - t < t - x[left]:
            left += 1
        near = slice(left, left + k)
        d = np.abs(x[near] - t)
        far = max(d.max(), 1e-12)
        if q > n:
            far += (q - n) // 2
        r = d / far
        w = np.where(r < 0.999, np.where(r > 0.001, (1 - r**3) ** 3, 1.0), 0.0) * weight[near]
        total = w.sum()
        if total <= 0:
            out[i] = y[near].mean()
            continue
        w = w / total
        if degree:
            centre = w @ x[near]
            spread = w @ (x[near] - centre) ** 2
            if np.sqrt(spread) > 0.001 * (n - 1):
                w = w * (1 + (t - centre) * (x[near] - centre) / spread)
        out[i] = w @ y[near]
    return out


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.ones(n) / n, "valid")


def stl_fitted(y: np.ndarray, period: int, robust: bool = True) -> np.ndarray:
    """Seasonal plus trend of a complete series with a periodic season."""
    y = np.asarray(y, float)
    n = len(y)
    season_window = 10 * n + 1
    trend_window = _odd(1.5 * period / (1 - 1.5 / season_window))
    low_window = _odd(period)
    inner, outer = (1, 15) if robust else (2, 0)
    weight, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    for step in range(outer + 1):
        for _ in range(inner):
            free = y - trend
            cycle = np.empty(n + 2 * period)
            for k in range(period):
                part, w = free[k::period], weight[k::period]
                places = np.arange(0.0, len(part) + 2)
                cycle[k::period][: len(places)] = loess(part, season_window, 0, w, places)
            low = _moving(_moving(_moving(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(low, low_window, 1, np.ones(n))
            trend = loess(y - season, trend_window, 1, weight)
        if step < outer:
            rest = np.abs(y - season - trend)
            h = 6 * np.median(rest)
            u = np.divide(rest, h, out=np.zeros(n), where=h > 0)
            weight = np.where(u < 0.001, 1.0, np.where(u > 0.999, 0.0, (1 - u**2) ** 2))
    # one value for each place of the cycle
    season = np.array([season[k::period].mean() for k in range(period)])[np.arange(n) % period]
    return season + trend
