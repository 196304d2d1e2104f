"""Exact likelihood of autoregressive moving averages, and its maximum for several orders at once.

Innovations come from the state-space form: a state of the coming values' known parts, with
the stationary covariance at first. All orders and all small changes of their coefficients go through the
recursion together as one batch, so a series takes one pass over its points a step. The
likelihood with the innovations' variance taken out is a sum of squares, which Gauss-Newton steps
lower from starting values.
"""

from __future__ import annotations

import numpy as np

#: Steps at most, and the relative gain that ends them.
STEPS, GAIN = 5, 1e-8


def inside(coefficients: np.ndarray) -> bool:
    """Whether 1 - c1 z - c2 z^2 ... has all its roots outside the unit circle."""
    roots = np.roots(np.concatenate([-coefficients[::-1], [1.0]])) if len(coefficients) else np.zeros(0)
    return bool((np.abs(roots) > 1 + 1e-6).all())


def innovations(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``y`` with the coefficients in the same row (zeros behind): innovations over the roots of
    their variances, the sum of the variances' logarithms, and the state before the next value.

    Variances are in units of the noise's."""
    rows, n = y.shape
    r = max(ar.shape[1], ma.shape[1] + 1)
    phi, load = np.zeros((rows, r)), np.zeros((rows, r))
    phi[:, : ar.shape[1]], load[:, 0], load[:, 1 : ma.shape[1] + 1] = ar, 1.0, ma
    noise = load[:, :, None] * load[:, None, :]
    t = np.zeros((rows, r, r))
    t[:, :, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] += 1.0
    square = np.eye(r * r) - np.einsum("bij,bkl->bikjl", t, t).reshape(rows, r * r, r * r)
    p = np.linalg.solve(square, noise.reshape(rows, r * r, 1)).reshape(rows, r, r)
    a, out, logs, settled = np.zeros((rows, r)), np.empty((rows, n)), np.zeros(rows), False
    for i in range(n):
        if not settled:
            f = p[:, 0, 0]
            moved = phi[:, :, None] * p[:, :1, :]
            moved[:, :-1] += p[:, 1:]  # the transition times p
            k = moved[:, :, 0] / f[:, None]
            after = moved[:, :, :1] * phi[:, None, :]
            after[:, :, :-1] += moved[:, :, 1:]
            after += noise - k[:, :, None] * k[:, None, :] * f[:, None, None]
            settled = bool(np.abs(after - p).max() < 1e-11)
            p, root, log = after, np.sqrt(f), np.log(f)
        v = y[:, i] - a[:, 0]
        out[:, i] = v / root
        logs += log
        a_next = phi * a[:, :1] + k * v[:, None]
        a_next[:, :-1] += a[:, 1:]
        a = a_next
    return out, logs, a


def log_likelihood(y: np.ndarray, ar: np.ndarray, ma: np.ndarray, variance: float | None = None) -> float:
    """Of a series with mean 0; without ``variance`` the likeliest one."""
    out, logs, _ = innovations(np.asarray(y, float)[None], np.asarray(ar, float)[None], np.asarray(ma, float)[None])
    n, square = len(y), float((out**2).sum())
    variance = square / n if variance is None else variance
    return -0.5 * (n * np.log(2 * np.pi * variance) + square / variance + float(logs[0]))


class Fit:
    """An order (p, q) with mean, coefficients, log-likelihood and AIC."""

    def __init__(self, p: int, q: int, theta: np.ndarray, constant: bool):
        self.p, self.q, self.constant = p, q, constant
        self.put(theta)
        self.square, self.likelihood, self.state = np.inf, -np.inf, np.zeros(1)

    def put(self, theta: np.ndarray) -> None:
        c = int(self.constant)
        self.theta, self.mean, self.ar, self.ma = theta, float(theta[0]) if c else 0.0, theta[c : c + self.p], theta[c + self.p :]

    @property
    def aic(self) -> float:
        return 2 * (self.p + self.q + self.constant + 1) - 2 * self.likelihood

    def forecast(self, h: int) -> np.ndarray:
        a, out = self.state.copy(), []
        phi = np.concatenate([self.ar, np.zeros(len(a) - self.p)])
        for _ in range(h):
            out.append(a[0] + self.mean)
            a = phi * a[0] + np.append(a[1:], 0.0)
        return np.array(out)


def _evaluate(y: np.ndarray, fits: list[Fit], thetas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals whose squares add up to what the likelihood falls with, log-likelihoods, and states."""
    width = max(1, *(f.p for f in fits)), max(1, *(f.q for f in fits))
    ar, ma, mean = np.zeros((len(fits), width[0])), np.zeros((len(fits), width[1])), np.zeros(len(fits))
    for i, (f, theta) in enumerate(zip(fits, thetas, strict=True)):
        c = int(f.constant)
        ar[i, : f.p], ma[i, : f.q], mean[i] = theta[c : c + f.p], theta[c + f.p :], theta[0] if c else 0.0
    out, logs, state = innovations(y[None] - mean[:, None], ar, ma)
    n = len(y)
    variance = np.maximum((out**2).mean(1), 1e-300)
    return out * np.exp(logs / (2 * n))[:, None], -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + logs), state


def fit_orders(y: np.ndarray, starts: dict[tuple[int, int], np.ndarray], constant: bool) -> list[Fit]:
    """The orders at their largest likelihood, from starting values (mean if ``constant``, then coefficients) that
    are stationary and invertible, as all steps are."""
    fits = [Fit(p, q, np.asarray(theta, float), constant) for (p, q), theta in starts.items()]
    allowed = lambda f, theta: inside(theta[int(constant) : int(constant) + f.p]) and inside(-theta[int(constant) + f.p :])
    live = list(fits)
    for _ in range(STEPS):
        if not live:
            break
        batch = [(f, f.theta) for f in live]
        nudges = {id(f): 1e-6 * (1 + np.abs(f.theta)) for f in live}
        batch += [(f, f.theta + nudges[id(f)] * (np.arange(len(f.theta)) == k)) for f in live for k in range(len(f.theta))]
        w, likelihood, state = _evaluate(y, *map(list, zip(*batch, strict=True)))
        tries, at = [], len(live)
        for i, f in enumerate(live):
            f.square, f.likelihood, f.state = float((w[i] ** 2).sum()), float(likelihood[i]), state[i]
            slope = ((w[at : at + len(f.theta)] - w[i]) / nudges[id(f)][:, None]).T
            at += len(f.theta)
            step = -np.linalg.lstsq(slope, w[i], rcond=None)[0]
            tries += [(f, theta) for scale in (1.0, 0.5, 0.2, 0.05) if np.isfinite(theta := f.theta + scale * step).all() and allowed(f, theta)]
        if not tries:
            break
        w, likelihood, state = _evaluate(y, *map(list, zip(*tries, strict=True)))
        best: dict[int, tuple[float, int]] = {}
        for i, (f, _) in enumerate(tries):
            square = float((w[i] ** 2).sum())
            if square < best.get(id(f), (f.square, -1))[0]:
                best[id(f)] = (square, i)
        moved = []
        for f in live:
            square, i = best.get(id(f), (f.square, -1))
            if i >= 0:
                gain = (f.square - square) / max(f.square, 1e-300)
                f.put(tries[i][1])
                f.square, f.likelihood, f.state = square, float(likelihood[i]), state[i]
                if gain > GAIN:
                    moved.append(f)
        live = moved
    return [f for f in fits if np.isfinite(f.likelihood)]
