"""Structural time-series models: a linear state-space form, its Kalman filter, and variances by maximum likelihood."""

from __future__ import annotations

import numpy as np

from tidewatch.functions.optimise import minimise

DIFFUSE = 1e6
#: Relative change of the covariance below which it counts as constant.
STEADY = 1e-10
#: Gradient, by value and logarithm of a variance, at which a search is left until the others are as far.
ROUGH = 3e-5


class Structural:
    """A level, optionally a slope, and seasons: each as trigonometric harmonics, or one as period - 1 dummies."""

    def __init__(self, slope: bool = True, periods: tuple[int, ...] = (), dummy: int | None = None, harmonics: int = 10):
        self.slope, blocks, seen, noise = slope, [], [], []
        if slope:
            blocks.append(np.array([[1.0, 1.0], [0.0, 1.0]]))
            seen += [1.0, 0.0]
            noise += [1, 2]
        else:
            blocks.append(np.ones((1, 1)))
            seen.append(1.0)
            noise.append(1)
        kind = max(noise)
        for p in periods:
            kind += 1
            for j in range(1, min(p // 2, harmonics) + 1):
                a = 2 * np.pi * j / p
                blocks.append(np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]))
                seen += [1.0, 0.0]
                noise += [kind, kind]
        if dummy:
            kind += 1
            m = np.zeros((dummy - 1, dummy - 1))
            m[0] = -1.0
            m[np.arange(1, dummy - 1), np.arange(dummy - 2)] = 1.0
            blocks.append(m)
            seen += [1.0] + [0.0] * (dummy - 2)
            noise += [kind] + [0] * (dummy - 2)
        self.size = len(seen)
        self.T = np.zeros((self.size, self.size))
        at = 0
        for b in blocks:
            self.T[at : at + len(b), at : at + len(b)] = b
            at += len(b)
        self.Z, self.noise, self.kinds = np.array(seen), np.array(noise), kind + 1
        self.dummies = slice(self.size - dummy + 1, self.size) if dummy else None

    def q(self, variances: np.ndarray) -> np.ndarray:
        """Diagonal of the states' noise; variances[0] is the observations', kind i has variances[i]."""
        return np.where(self.noise > 0, np.append(variances, 0.0)[self.noise], 0.0)

    def filter(self, y: np.ndarray, variances: np.ndarray, innovations: list | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood without the first size innovations, and the state after the last value, predicted one ahead. Once
        the covariance stands still, so do the gains. innovations gets each value's one-step residual."""
        a, P, Q = np.zeros(self.size), np.eye(self.size) * DIFFUSE, np.diag(self.q(variances))
        total, steady = 0.0, False
        for i, v in enumerate(y):
            if not steady:
                m = P @ self.Z
                f = self.Z @ m + variances[0]
                k = m / f
                after = self.T @ (P - np.outer(k, m)) @ self.T.T + Q
                steady = i >= self.size and bool(np.abs(after - P).max() <= STEADY * np.abs(P).max())
                P = after
            e = v - self.Z @ a
            if innovations is not None:
                innovations.append(e)
            if i >= self.size:
                total -= 0.5 * (np.log(2 * np.pi * f) + e * e / f)
            a = self.T @ (a + k * e)
        return total, a, P

    def turned(self, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """What observes the states at each of n times, and what the dummies' noise then moves, in coordinates in which
        seasons stand still: a season's states at time t are its first ones turned t times. Only the slope still moves the
        level, and harmonics' noise, alike in both of a pair's states, stays as it is."""
        step = self.T.copy()
        if self.slope:
            step[0, 1] = 0.0
        seen, z = np.empty((n, self.size)), self.Z.copy()
        for t in range(n):
            seen[t], z = z, z @ step
        if not self.dummies:
            return seen, None
        back, w, moved = np.linalg.inv(step[self.dummies, self.dummies]), np.zeros(self.size), np.empty((n, self.size))
        w[self.dummies.start] = 1.0
        for t in range(n):
            w[self.dummies] = np.round(back @ w[self.dummies])  # entries are -1, 0 and 1
            moved[t] = w
        return seen, moved

    def score(self, y: np.ndarray, variances: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of all values from the first on, and its gradient by the variances (Koopman and Shephard, 1992:
        smoothed disturbances against their variances)."""
        n, size = len(y), self.size
        seen, moved = self.turned(n)
        quiet = np.zeros(size, bool)
        if self.dummies:
            quiet[self.dummies] = True
        Q = np.where(quiet, 0.0, self.q(variances))
        a, P, buffer = np.zeros(size), np.eye(size) * DIFFUSE, np.empty((size, size))
        inside, diagonal = P.reshape(-1)[:: size + 1], np.arange(size)
        e, f, gain = np.empty(n), np.empty(n), np.empty((n, size))
        for i in range(n):
            z = seen[i]
            m = P @ z
            f[i] = z @ m + variances[0]
            k = m / f[i]
            e[i], gain[i] = y[i] - z @ a, k
            a += k * e[i]
            P -= np.multiply(m[:, None], k, out=buffer)
            if self.slope:
                a[0] += a[1]
                P[0] += P[1]
                P[:, 0] += P[:, 1]
            inside += Q
            if moved is not None:
                P += variances[-1] * np.multiply(moved[i][:, None], moved[i], out=buffer)
        total = -0.5 * float((np.log(2 * np.pi * f) + e * e / f).sum())
        r, N = np.zeros(size), np.zeros((size, size))
        by_noise = by_dummies = 0.0
        by_state = np.zeros(size)
        for i in range(n - 1, -1, -1):
            z, k = seen[i], gain[i]
            by_state += r * r - N[diagonal, diagonal]
            if moved is not None:
                w = moved[i]
                by_dummies += (w @ r) ** 2 - w @ N @ w
            if self.slope:
                r[1] += r[0]
                N[1] += N[0]
                N[:, 1] += N[:, 0]
            g = N @ k
            spread = 1 / f[i] + k @ g
            u = e[i] / f[i] - k @ r
            by_noise += u * u - spread
            r += z * u
            g -= 0.5 * spread * z
            np.multiply(z[:, None], g, out=buffer)
            N -= buffer
            N -= buffer.T
        slope = np.zeros(self.kinds)
        np.add.at(slope, self.noise[(self.noise > 0) & ~quiet], 0.5 * by_state[(self.noise > 0) & ~quiet])
        slope[0] = 0.5 * by_noise
        if moved is not None:
            slope[-1] = 0.5 * by_dummies
        return total, slope

    def likelihood(self, y: np.ndarray, variances: np.ndarray) -> tuple[float, np.ndarray]:
        """What filter() gives as log-likelihood, and its gradient: that of all values less that of the first size ones."""
        (whole, up), (first, down) = self.score(y, variances), self.score(y[: self.size], variances)
        return whole - first, up - down

    def starts(self) -> list[np.ndarray]:
        """Shares of the sample variance that searches begin with: mostly noise, mostly level, and mostly slope."""
        small = [1e-6] * (self.kinds - 2)
        out = [np.array([0.9, 1e-5, *[1e-5] * len(small)]), np.array([0.05, 0.5, *small])]
        return [*out, np.array([0.1, 1e-4, 0.05, *small[1:]])] if self.slope else out

    def fit(self, y: np.ndarray, window: int | None = None) -> np.ndarray:
        """Variances of the largest likelihood, searched on their logarithms: from each of starts() as far as the gradient
        tells them apart, then from the best until it vanishes. A variance that only gets smaller ends at e^-25 of the
        sample variance. window: the last values, all by default."""
        y = np.asarray(y, float)
        part = y if window is None else y[-window:]
        scale = max(part.var(), 1e-12) if len(part) else 1.0
        if len(part) <= self.size:
            return scale * self.starts()[0]
        n = len(part) - self.size

        def work(logs):
            value, slope = self.likelihood(part, np.exp(logs))
            return -value / n, -slope * np.exp(logs) / n

        low, high = np.full(self.kinds, np.log(scale) - 25), np.full(self.kinds, np.log(scale) + 25)
        rough = min((minimise(work, np.log(scale * s), low, high, ROUGH) for s in self.starts()), key=lambda f: f[0])
        return np.exp(minimise(work, rough[1], low, high)[1])

    def forecast(self, y: np.ndarray, variances: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of the next steps, with no update on the way."""
        _, a, P = self.filter(np.asarray(y, float), variances)
        Q = np.diag(self.q(variances))
        mean, sd = np.empty(steps), np.empty(steps)
        for h in range(steps):
            mean[h] = self.Z @ a
            sd[h] = np.sqrt(self.Z @ P @ self.Z + variances[0])
            a, P = self.T @ a, self.T @ P @ self.T.T + Q
        return mean, sd


def local_level(y: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Filtered level and its variance with fixed noise: the first value starts it."""
    level, var = np.empty(len(y)), np.empty(len(y))
    a, p = y[0] if len(y) else 0.0, r
    for i, v in enumerate(y):
        if i:
            p += q
            k = p / (p + r)
            a, p = a + k * (v - a), (1 - k) * p
        level[i], var[i] = a, p
    return level, var
