"""Online changepoint detection: run-length posteriors under a normal-inverse-gamma model and a constant hazard."""

from __future__ import annotations

from math import lgamma, pi

import numpy as np

_RATIO = np.zeros(0)


def _log_ratio(n: int) -> np.ndarray:
    """log of Gamma((v + 1) / 2) / Gamma(v / 2) for v = 2, 3, ..., n of them: alpha is 1 + j / 2 for run length j."""
    global _RATIO
    if len(_RATIO) < n:
        _RATIO = np.array([lgamma((v + 1) / 2) - lgamma(v / 2) for v in range(2, 2 * n + 2)])
    return _RATIO[:n]


class RunLengths:
    """The posterior over run lengths and their sufficient statistics; update() takes one value.

    eps is added to the evidence. tail drops the longest run lengths while their mass is below it (0 keeps all).
    """

    def __init__(self, hazard: float = 0.01, eps: float = 0.0, tail: float = 0.0):
        self.hazard, self.eps, self.tail = hazard, eps, tail
        self.r = np.ones(1)
        self.mu, self.kappa, self.alpha, self.beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)

    def update(self, x: float) -> np.ndarray:
        v = 2 * self.alpha
        scale = self.beta * (self.kappa + 1) / (self.alpha * self.kappa)
        log_c = _log_ratio(len(v)) - 0.5 * np.log(v * pi * scale)
        like = np.exp(log_c - (v + 1) / 2 * np.log1p((x - self.mu) ** 2 / (v * scale)))
        mass = self.r * like
        r = np.concatenate([[self.hazard * mass.sum()], (1 - self.hazard) * mass])
        self.r = r / (r.sum() + self.eps)
        mu = (self.kappa * self.mu + x) / (self.kappa + 1)
        beta = self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1))
        self.mu, self.beta = np.concatenate([[0.0], mu]), np.concatenate([[1.0], beta])
        self.kappa, self.alpha = np.concatenate([[1.0], self.kappa + 1]), np.concatenate([[1.0], self.alpha + 0.5])
        if self.tail:
            keep = max(1, int(np.searchsorted(-np.cumsum(self.r[::-1])[::-1], -self.tail)))
            self.r, self.mu, self.kappa, self.alpha, self.beta = (a[:keep] for a in (self.r, self.mu, self.kappa, self.alpha, self.beta))
        return self.r

    def state(self) -> bytes:
        return np.stack([self.r, self.mu, self.kappa, self.alpha, self.beta]).tobytes()

    @classmethod
    def restored(cls, state: bytes, **settings) -> RunLengths:
        self = cls(**settings)
        self.r, self.mu, self.kappa, self.alpha, self.beta = np.frombuffer(state).reshape(5, -1).copy()
        return self


def detect(y: np.ndarray, hazard: float = 0.01, eps: float = 1e-9) -> np.ndarray:
    """P(run length 0) at each value of the standardised series."""
    y = (y - y.mean()) / (y.std() + 1e-9)
    runs = RunLengths(hazard, eps)
    return np.array([runs.update(v)[0] for v in y])
