"""Bounded minimisation of smooth functions: quasi-Newton steps on the variables that are free to move."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Never reached by a fit that converges; a guard against functions without a minimum.
STEPS = 1000


def minimise(work: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, tol: float = 1e-6) -> tuple[float, np.ndarray]:
    """The least value found from start within bounds, and where. work gives value and gradient, or an infinite value where
    there is none. Ends when no component of the gradient that may be followed exceeds tol, or when no step along the
    direction or the gradient itself makes the value smaller by more than rounding."""
    x = np.clip(np.asarray(start, float), low, high)
    value, slope = work(x)
    if not np.isfinite(value):
        return np.inf, x
    curve = np.eye(len(x))
    for _ in range(STEPS):
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if not free.any() or np.abs(slope[free]).max() <= tol:
            break
        way = np.zeros(len(x))
        way[free] = -(curve[np.ix_(free, free)] @ slope[free])
        if way @ slope >= -1e-12 * np.abs(way).max() * np.abs(slope).max():
            curve, way = np.eye(len(x)), np.where(free, -slope, 0.0)
        step = min(1.0, 4.0 / np.abs(way).max())
        found = None
        while step > 1e-12:
            trial = np.clip(x + step * way, low, high)
            new, new_slope = work(trial)
            if np.isfinite(new) and new <= value + 1e-4 * slope @ (trial - x):
                found = trial, new, new_slope
                break
            step *= 0.3
        if found is None:
            if np.array_equal(curve, np.eye(len(x))):
                break
            curve = np.eye(len(x))
            continue
        trial, new, new_slope = found
        moved, turned = trial - x, new_slope - slope
        along = moved @ turned
        if along > 1e-10 * np.linalg.norm(moved) * np.linalg.norm(turned):
            if np.array_equal(curve, np.eye(len(x))):
                curve *= along / (turned @ turned)
            left = np.eye(len(x)) - np.outer(moved, turned) / along
            curve = left @ curve @ left.T + np.outer(moved, moved) / along
        small = value - new <= 1e-13 * max(1.0, abs(value))
        x, value, slope = trial, new, new_slope
        if small:
            break
    return value, x
