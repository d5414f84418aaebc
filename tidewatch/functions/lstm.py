"""A recurrent network of stacked LSTM layers with a linear head, trained by Adam on windows; numpy, seeded."""

from __future__ import annotations

import numpy as np


class Network:
    def __init__(self, hidden: int = 64, layers: int = 2, seed: int = 0, kind: type = np.float64):
        rng, edge = np.random.default_rng(seed), hidden**-0.5
        draw = lambda *shape: rng.uniform(-edge, edge, shape).astype(kind)
        self.hidden, self.kind = hidden, kind
        self.p = []
        for i in range(layers):
            self.p += [draw((1 if i == 0 else hidden) + hidden, 4 * hidden), draw(4 * hidden)]
        self.p += [draw(hidden, 1), draw(1)]
        # sigmoids as tanh of half the argument: the first three gates of four
        self.half = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], kind), hidden)

    def forward(self, x: np.ndarray):
        """x: (rows, steps). The head's output on the last step, and what backward() needs."""
        n, steps = x.shape
        H = self.hidden
        inp, kept = np.ascontiguousarray(x.T, self.kind)[:, :, None], []
        for W, b in zip(self.p[:-2:2], self.p[1:-2:2], strict=True):
            wide = len(W) - H
            gates = inp @ (W[:wide] * self.half) + b * self.half
            across = W[wide:] * self.half
            h, c = np.zeros((steps + 1, n, H), self.kind), np.zeros((steps + 1, n, H), self.kind)
            bent = np.empty((steps, n, H), self.kind)
            for t in range(steps):
                a = gates[t]
                a += h[t] @ across
                np.tanh(a, out=a)
                a[:, : 3 * H] += 1
                a[:, : 3 * H] *= 0.5
                np.multiply(a[:, H : 2 * H], c[t], out=c[t + 1])
                c[t + 1] += a[:, :H] * a[:, 3 * H :]
                np.tanh(c[t + 1], out=bent[t])
                np.multiply(a[:, 2 * H : 3 * H], bent[t], out=h[t + 1])
            kept.append((inp, gates, h, c, bent))
            inp = h[1:]
        return inp[-1] @ self.p[-2] + self.p[-1], kept

    def backward(self, error: np.ndarray, kept) -> list[np.ndarray]:
        """Gradients of the parameters from the output's."""
        H = self.hidden
        grads = [None] * len(self.p)
        top = kept[-1][2]
        steps, n = len(top) - 1, top.shape[1]
        grads[-2], grads[-1] = top[-1].T @ error, error.sum(0)
        into = np.zeros((steps, n, H), self.kind)
        into[-1] = error @ self.p[-2].T
        for layer in reversed(range(len(kept))):
            inp, gates, h, c, bent = kept[layer]
            W = self.p[2 * layer]
            wide = len(W) - H
            across = np.ascontiguousarray(W[wide:].T)
            turn = np.empty_like(gates)
            dh, dc = np.zeros((n, H), self.kind), np.zeros((n, H), self.kind)
            for t in reversed(range(steps)):
                i, f, o, g = (gates[t][:, k * H : (k + 1) * H] for k in range(4))
                dh = dh + into[t]
                dc += dh * o * (1 - bent[t] ** 2)
                a = turn[t]
                a[:, :H] = dc * g * i * (1 - i)
                a[:, H : 2 * H] = dc * c[t] * f * (1 - f)
                a[:, 2 * H : 3 * H] = dh * bent[t] * o * (1 - o)
                a[:, 3 * H :] = dc * i * (1 - g * g)
                dh = a @ across
                dc *= f
            flat = turn.reshape(-1, 4 * H)
            grads[2 * layer] = np.concatenate([inp.reshape(-1, wide).T @ flat, h[:-1].reshape(-1, H).T @ flat])
            grads[2 * layer + 1] = flat.sum(0)
            into = turn @ W[:wide].T
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 1e-3, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        x, y = np.asarray(x, self.kind), np.asarray(y, self.kind)
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at, t = order[lo : lo + batch], t + 1
                out, memory = self.forward(x[at])
                for k, g in enumerate(self.backward(2 * (out - y[at, None]) / len(at), memory)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def predict(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[lo : lo + batch])[0][:, 0] for lo in range(0, len(x), batch)]) if len(x) else np.zeros(0)


def windows(y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(y) <= length:
        return np.zeros((0, length)), np.zeros(0)
    return np.lib.stride_tricks.sliding_window_view(y[:-1], length), y[length:]
