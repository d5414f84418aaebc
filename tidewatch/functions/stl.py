"""Seasonal-trend decomposition by local regression (Cleveland et al., 1990) on evenly spaced values."""

from __future__ import annotations

import numpy as np


def odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Local lines with tricube weights over the span nearest points, times the points' own weights, at places at. y and
    weights may have leading axes: rows that are smoothed alike. Where all weights are 0 a point stays as it is."""
    n = y.shape[-1]
    at = np.arange(n, dtype=float) if at is None else at
    q = min(span, n)
    first = np.clip(np.round(at).astype(int) - (q - 1) // 2, 0, n - q)
    near = first[:, None] + np.arange(q)
    away = near - at[:, None]
    far = np.abs(away)
    reach = (far.max(1) + (span - n) // 2 * (span > n))[:, None]
    cube = np.where(far <= 0.001 * reach, 1.0, np.where(far <= 0.999 * reach, (1 - (far / np.maximum(reach, 1e-12)) ** 3) ** 3, 0.0))
    w = cube * weights[..., near]
    total = w.sum(-1, keepdims=True)
    w = w / np.where(total > 0, total, 1.0)
    v = y[..., near]
    mean_x = (w * away).sum(-1, keepdims=True)
    dx = away - mean_x
    var = (w * dx * dx).sum(-1)
    slope = np.where(np.sqrt(var) > 0.001 * (n - 1), (w * dx * v).sum(-1) / np.maximum(var, 1e-300), 0.0)
    own = y[..., np.clip(np.round(at).astype(int), 0, n - 1)]
    return np.where(total[..., 0] > 0, (w * v).sum(-1) - slope * mean_x[..., 0], own)


def average(y: np.ndarray, k: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(y)])
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int = 48, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trend, seasonal, residual; they add up to y. Series under two periods have their mean as trend and no season."""
    n = len(y)
    if n < 2 * period or period < 2:
        trend = np.full(n, y.mean() if n else 0.0)
        return trend, np.zeros(n), y - trend
    wide, low = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    trend, weights = np.zeros(n), np.ones(n)
    season = np.zeros(n)
    for outer in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            left = y - trend
            cycle = np.empty(n + 2 * period)
            for phases in (np.arange(n % period), np.arange(n % period, period)):  # of one length each
                if len(phases):
                    rows = np.arange(phases[0], n, period)[None, :] + (phases - phases[0])[:, None]
                    out = loess(left[rows], seasonal, weights[rows], np.arange(-1, rows.shape[1] + 1, dtype=float))
                    cycle[phases[:, None] + period * np.arange(out.shape[1])] = out
            smooth = average(average(average(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(smooth, low, np.ones(n))
            trend = loess(y - season, wide, weights)
        rest = np.abs(y - season - trend)
        h = 6 * np.median(rest)
        if h <= 0:
            break
        if outer < 14:
            weights = np.where(rest <= 0.001 * h, 1.0, np.where(rest <= 0.999 * h, (1 - (rest / h) ** 2) ** 2, 0.0))
    return trend, season, y - season - trend
