"""Gaussian-process regression on evenly spaced rows with sums of scaled RBF and periodic kernels and white noise.

Between evenly spaced rows the covariance depends on their distance alone. Durbin and Levinson's recursion then gives
determinant, solutions and the inverse's first column in time quadratic in the rows, and Gohberg and Semencul's formula the
sums along the inverse's diagonals, which are all that the evidence's gradient needs.
"""

from __future__ import annotations

import numpy as np

from tidewatch.functions.optimise import minimise

#: Bounds of parameters that have none of their own.
WIDE = (1e-5, 1e5)


class Kernel:
    """Parameters: amplitude and length of the RBF, then amplitude, length and period of each season, then the noise.

    periods: (start, low, high) of each season's period; rbf, noise: start, low and high; amplitudes: bounds of all
    amplitudes. Seasons' lengths start at 1, amplitudes at 50 (RBF) and 1.
    """

    def __init__(self, periods: tuple[tuple[float, float, float], ...], rbf: tuple[float, float, float] = (50.0, 10.0, 200.0), noise: tuple[float, float, float] = (1.0, *WIDE), amplitudes: tuple[float, float] = (1e-3, 1e3)):
        self.start, self.low, self.high = [50.0, rbf[0]], [amplitudes[0], rbf[1]], [amplitudes[1], rbf[2]]
        for p, lo, hi in periods:
            self.start += [1.0, 1.0, p]
            self.low += [amplitudes[0], WIDE[0], lo]
            self.high += [amplitudes[1], WIDE[1], hi]
        self.start.append(noise[0])
        self.low.append(noise[1])
        self.high.append(noise[2])

    @staticmethod
    def smooth(p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Covariances at distances d without the noise."""
        out = p[0] * np.exp(-0.5 * (d / p[1]) ** 2)
        for i in range(2, len(p) - 1, 3):
            out += p[i] * np.exp(-2 * (np.sin(np.pi * d / p[i + 2]) / p[i + 1]) ** 2)
        return out

    @staticmethod
    def slopes(p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The covariances' derivatives by the parameters' logarithms, one row each; the noise is at distance 0 only."""
        trend = p[0] * np.exp(-0.5 * (d / p[1]) ** 2)
        out = [trend, trend * (d / p[1]) ** 2]
        for a, length, period in p[2:-1].reshape(-1, 3):
            angle = np.pi * d / period
            s, c = np.sin(angle), np.cos(angle)
            season = a * np.exp(-2 * (s / length) ** 2)
            out += [season, season * 4 * (s / length) ** 2, season * 4 * s * c * angle / length**2]
        return np.stack([*out, np.where(d == 0, p[-1], 0.0)])


def predictors(c: np.ndarray):
    """For each row from the second on, how it is predicted from those before (nearest first), and the error's variance: one
    pair at a time for covariances c by distance. Ends early where c is none of a process."""
    e, phi = c[0], np.zeros(len(c))
    for t in range(1, len(c)):
        a = (c[t] - phi[: t - 1] @ c[t - 1 : 0 : -1]) / e
        e *= 1 - a * a
        if not (abs(a) < 1 and e > 0):
            return
        phi[: t - 1] -= a * phi[: t - 1][::-1].copy()
        phi[t - 1] = a
        yield phi[:t], e


def evidence(p: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log evidence of values at rows 0, 1, 2, ... and its gradient by the parameters' logarithms."""
    n = len(y)
    d = np.arange(n, dtype=float)
    c = Kernel.smooth(p, d)
    c[0] += p[-1]
    log, alpha, phi, e, t = np.log(c[0]), np.zeros(n), np.zeros(0), c[0], 1
    alpha[0] = y[0] / c[0]
    for t, (phi, e) in enumerate(predictors(c), 2):
        log += np.log(e)
        left = (y[t - 1] - phi[::-1] @ y[: t - 1]) / e
        alpha[: t - 1] -= left * phi[::-1]
        alpha[t - 1] = left
    if t < n:
        return -np.inf, np.zeros(len(p))
    first = np.append(1.0, -phi) / e
    pairs = lambda a, b: np.correlate(b, a, "full")[n - 1 :]  # sums of a[j] * b[j + lag]
    inverse = ((n - d) * pairs(first, first) - 2 * pairs(first * d, first)) / first[0]
    weight = np.where(d == 0, 0.5, 1.0) * (pairs(alpha, alpha) - inverse)
    return -0.5 * (y @ alpha + log + n * np.log(2 * np.pi)), Kernel.slopes(p, d) @ weight


def fit(kernel: Kernel, y: np.ndarray, restarts: int = 1, sample: int | None = None, seed: int = 0) -> np.ndarray:
    """Parameters within bounds of the largest evidence of y, scaled to mean 0 and deviation 1: the best of searches from the
    kernel's start and from restarts places drawn evenly on logarithms, each until the gradient vanishes. sample: the last
    rows only."""
    rng = np.random.default_rng(seed)
    low, high = np.log(kernel.low), np.log(kernel.high)
    y = np.asarray(y, float)
    if not len(y):
        return np.array(kernel.start)
    z = ((y if sample is None else y[-sample:]) - y.mean()) / (y.std() or 1.0)

    def work(logs):
        value, slope = evidence(np.exp(logs), z)
        return -value / len(z), -slope / len(z)

    starts = [np.log(kernel.start), *[rng.uniform(low, high) for _ in range(restarts)]]
    return np.exp(min((minimise(work, s, low, high) for s in starts), key=lambda f: f[0])[1])


def predict(p: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation, noise included, in the units of y, at places at counted from y's first row."""
    n, mu, sd = len(y), y.mean() if len(y) else 0.0, (y.std() if len(y) else 0.0) or 1.0
    own = Kernel.smooth(p, np.zeros(1))[0] + p[-1]
    if not n:
        return np.full(len(at), mu), np.full(len(at), np.sqrt(own) * sd)
    c = Kernel.smooth(p, np.arange(n, dtype=float))
    c[0] += p[-1]
    sides = np.column_stack([(y - mu) / sd, Kernel.smooth(p, np.arange(n)[:, None] - np.asarray(at, float)[None, :])])
    left, e = sides[0], c[0]
    both, own_part = left[0] * left[1:] / e, left[1:] ** 2 / e
    for t, (phi, e) in enumerate(predictors(c), 1):
        left = sides[t] - phi[::-1] @ sides[:t]
        both += left[0] * left[1:] / e
        own_part += left[1:] ** 2 / e
    return both * sd + mu, np.sqrt(np.maximum(own - own_part, 0)) * sd
