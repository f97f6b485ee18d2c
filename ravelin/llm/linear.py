"""Small linear models on the driver: dense and sparse logistic regression."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method. The rarer kind counts for more, by the root of the kinds'
    ratio. A step is halved until it lowers the loss, without which the
    method may run away where the kinds are nearly separable."""
    a = np.column_stack([x, np.ones(len(x))])
    w, r = np.zeros(a.shape[1]), ridge * len(a) ** 0.5
    share = np.clip(y.mean(), 1 / (len(y) + 1), 1 - 1 / (len(y) + 1))
    weight = np.where(y == 1, ((1 - share) / share) ** 0.25, (share / (1 - share)) ** 0.25)
    loss = lambda v: (weight * (np.logaddexp(0, a @ v) - y * (a @ v))).sum() + 0.5 * r * (v * v).sum()
    here = loss(w)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + r * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - r * w)
        while (there := loss(w + step)) > here and np.abs(step).max() > 1e-10:
            step /= 2
        if there > here or np.abs(step).max() < 1e-9:
            break
        w, here = w + step, there
    return w


class Rows:
    """Sparse rows: columns and values one after the other, with each row's end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        lens = np.array([len(c) for c, _ in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), lens)
        self.col = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def back(self, e: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * e[self.row], minlength=size)


def sparse_fit(x: Rows, dense: np.ndarray, y: np.ndarray, size: int, ridge: float, rounds: int = 150) -> np.ndarray:
    """Logistic weights of `size` sparse columns, the dense ones, and the intercept, by accelerated gradient steps."""
    d = np.column_stack([dense, np.ones(x.n)])
    w = np.zeros(size + d.shape[1])
    look, t = w.copy(), 1.0
    norm = np.bincount(x.row, x.val**2, minlength=x.n) + (d**2).sum(axis=1)
    weight = np.where(y == 1, 0.5 * x.n / max(1, y.sum()), 0.5 * x.n / max(1, x.n - y.sum())) ** 0.5
    rate = 1 / (0.25 * (weight * norm).max() * 0.1 * x.n + ridge * x.n)
    fit = lambda v: x.dot(v[:size]) + d @ v[size:]
    loss = lambda v, z: (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * (v[:-1] ** 2).sum()
    z = fit(look)
    for _ in range(rounds):
        e = weight * (sigmoid(z) - y)
        g = np.concatenate([x.back(e, size), d.T @ e])
        g[:-1] += ridge * look[:-1]
        here, gg = loss(look, z), g @ g
        rate *= 2
        while True:  # a step that lowers the loss enough
            new = look - rate * g
            zn = fit(new)
            if loss(new, zn) <= here - 0.5 * rate * gg + 1e-12 or rate < 1e-12:
                break
            rate /= 2
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t_new * (new - w)
        w, t, z = new, t_new, fit(look)
    return w
