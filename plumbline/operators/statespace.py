"""Exact-likelihood ARIMA by a Kalman filter, damped trend smoothing, and the simplex search that fits both.

An ARIMA model of d differences with diffuse start values has the likelihood of the ARMA model of the
differenced series, whose filter starts from the stationary covariance. Parameters are searched as partial
autocorrelations, so every trial is stationary and invertible.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Partial autocorrelations stay this far from 1, so that a stationary covariance exists.
INNER = 0.9999


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, *, size: float = 0.5, steps: int = 1000, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """A local minimum of ``f`` by the downhill simplex of Nelder and Mead, restarted once around what it found."""
    best, value = np.asarray(start, float), math.inf
    for width in (size, size / 4):
        points = [best, *(best + width * np.eye(len(best)))]
        values = [f(p) for p in points]
        for _ in range(steps):
            order = np.argsort(values, kind="stable")
            points, values = [points[i] for i in order], [values[i] for i in order]
            if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance) and max(np.abs(p - points[0]).max() for p in points) < 1e-5:
                break
            centre = np.mean(points[:-1], axis=0)
            away = centre - points[-1]
            trial, at = centre + away, f(centre + away)
            if at < values[0]:
                far = f(centre + 2 * away)
                trial, at = (centre + 2 * away, far) if far < at else (trial, at)
            elif at >= values[-2]:
                near = centre + (0.5 if at < values[-1] else -0.5) * away
                inner = f(near)
                if inner < min(at, values[-1]):
                    trial, at = near, inner
                else:
                    points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
                    values = [values[0], *(f(p) for p in points[1:])]
                    continue
            points[-1], values[-1] = trial, at
        best, value = points[int(np.argmin(values))], min(values)
    return best, value


def coefficients(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers, by way of partial autocorrelations."""
    out = np.zeros(0)
    for r in INNER * np.asarray(raw, float) / np.sqrt(1 + np.asarray(raw, float) ** 2):
        out = np.append(out - r * out[::-1], r)
    return out


def raw_of(phi: np.ndarray) -> np.ndarray:
    """The numbers whose ``coefficients`` are ``phi``."""
    out, phi = [], np.asarray(phi, float)
    while len(phi):
        r = float(np.clip(phi[-1], -INNER, INNER))
        out.append(r / math.sqrt(max(INNER * INNER - r * r, 1e-12)))
        phi = (phi[:-1] + r * phi[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def arma_filter(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(innovations, their variances over that of the noise, the state after the last value) of an ARMA process.

    The state holds what is known of the next r = max(p, q + 1) values. Once the variance has settled at 1 the
    covariance no longer moves.
    """
    r = max(len(phi), len(theta) + 1)
    a = np.zeros((r, r))
    a[: len(phi), 0] = phi
    a[np.arange(r - 1), np.arange(1, r)] = 1
    load = np.append(1.0, theta)
    load = np.append(load, np.zeros(r - len(load)))
    noise = np.outer(load, load)
    cov = np.linalg.solve(np.eye(r * r) - np.kron(a, a), noise.ravel()).reshape(r, r)
    state, out, variances = np.zeros(r), np.empty(len(y)), np.ones(len(y))
    for t, value in enumerate(y):
        f = cov[0, 0]
        if t >= r and abs(f - 1) < 1e-13:
            return _settled(y, out, variances, t, phi, theta, r)
        out[t], variances[t] = value - state[0], f
        gain = cov[:, 0] / f
        state = a @ (state + gain * out[t])
        cov = a @ (cov - np.outer(gain, cov[0])) @ a.T + noise
    return out, variances, state


def _settled(y: np.ndarray, out: np.ndarray, variances: np.ndarray, t: int, phi: np.ndarray, theta: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rest of the filter from ``t`` on, where innovations follow the equation of the process itself."""
    values, e, ar, ma = y.tolist(), out.tolist(), phi.tolist(), theta.tolist()
    for k in range(t, len(values)):
        ahead = 0.0
        for i, c in enumerate(ar, 1):
            ahead += c * values[k - i]
        for j, c in enumerate(ma, 1):
            ahead += c * e[k - j]
        e[k] = values[k] - ahead
    n = len(values)
    state = [sum(ar[i] * values[n + k - 1 - i] for i in range(k, len(ar))) + sum(ma[j] * e[n + k - 1 - j] for j in range(k, len(ma))) for k in range(r)]
    return np.array(e), variances, np.array(state)


def log_likelihood(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> float:
    """Gaussian log likelihood with the variance of the noise at its best."""
    e, f, _ = arma_filter(y, phi, theta)
    n, scale = len(y), float(np.mean(e * e / f))
    return -0.5 * (n * math.log(2 * math.pi * max(scale, 1e-300)) + float(np.log(f).sum()) + n)


class Arima:
    """ARIMA of a fixed order by exact maximum likelihood; a mean is estimated only without differences."""

    def __init__(self, order: tuple[int, int, int] = (1, 1, 1)) -> None:
        self.order, self.name = order, f"arima{''.join(map(str, order))}"

    def fit(self, history: np.ndarray) -> Arima:
        p, d, q = self.order
        y = np.diff(np.asarray(history, float), d) if d else np.asarray(history, float)
        self.centre = float(np.mean(y)) if d == 0 else 0.0
        self.scale = float(np.sqrt(np.mean((y - self.centre) ** 2))) or 1.0
        z = (y - self.centre) / self.scale

        def split(x):
            return coefficients(x[:p]), -coefficients(-x[p : p + q]), (x[-1] if d == 0 else 0.0)

        def loss(x):
            phi, theta, mean = split(x)
            return -log_likelihood(z - mean, phi, theta)

        starts = [np.zeros(p + q + (d == 0))]
        for sign in (0.5, -0.5):
            at = np.zeros(p + q + (d == 0))
            at[:1] = sign
            starts.append(at)
        found = min((simplex(loss, s) for s in starts), key=lambda r: r[1])
        self.phi, self.theta, mean = split(found[0])
        self.mean, self.value = self.centre + self.scale * mean, -found[1] - len(z) * math.log(self.scale)
        _, _, self.state = arma_filter(z - mean, self.phi, self.theta)
        return self

    def forecast(self, history: np.ndarray, horizon: int) -> np.ndarray:
        """Forecasts from the end of the history; the last value where it is too short or flat or the fit fails."""
        p, d, q = self.order
        history = np.asarray(history, float)
        still = np.repeat(history[-1], horizon)
        if len(history) - d < 3 * (p + q + 2) or not (np.diff(history, d).any() if d else np.std(history) > 0):
            return still
        try:
            self.fit(history)
        except (np.linalg.LinAlgError, OverflowError):
            return still
        ahead, state = [], self.state
        for _ in range(horizon):
            ahead.append(state[0])
            state = np.append(state[1:], 0.0) + np.append(self.phi, np.zeros(len(state) - p)) * state[0]
        out = np.array(ahead) * self.scale + self.mean
        for k in range(d - 1, -1, -1):
            out = (np.diff(history, k) if k else history)[-1] + np.cumsum(out)
        return out if np.isfinite(out).all() else still


class Holt:
    """Additive damped trend; smoothing and damping by simplex search, the start values by least squares."""

    name = "holt"

    @staticmethod
    def errors(y: np.ndarray, alpha: float, beta: float, phi: float, level: float, trend: float) -> tuple[np.ndarray, float, float]:
        """(one-step errors, last level, last trend); the trend moves by beta times the error."""
        out = []
        for v in y:
            ahead = level + phi * trend
            e = v - ahead
            out.append(e)
            level, trend = ahead + alpha * e, phi * trend + beta * e
        return np.array(out), level, trend

    @classmethod
    def start(cls, y: np.ndarray, alpha: float, beta: float, phi: float) -> tuple[float, float, float]:
        """(level, trend, sum of squares): errors are linear in the start values, so the best ones solve two equations."""
        zero = np.zeros(len(y))
        base = cls.errors(y, alpha, beta, phi, 0.0, 0.0)[0]
        moves = -np.column_stack([cls.errors(zero, alpha, beta, phi, 1.0, 0.0)[0], cls.errors(zero, alpha, beta, phi, 0.0, 1.0)[0]])
        level, trend = np.linalg.lstsq(moves, base, rcond=None)[0]
        rest = base - moves @ np.array([level, trend])
        return float(level), float(trend), float(rest @ rest)

    @staticmethod
    def shape(x: np.ndarray) -> tuple[float, float, float]:
        """alpha in (0, 1), beta in (0, alpha), damping in (0.8, 0.995)."""
        a, b, f = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return float(a), float(a * b), float(0.8 + 0.195 * f)

    def fit(self, history: np.ndarray) -> Holt:
        y = np.asarray(history, float)
        scale = float(np.std(y)) or 1.0
        z = (y - y[0]) / scale
        starts = [np.array(s, float) for s in ((0, -2, 1), (2, -1, 1), (-2, -1, 1), (0, 1, -1), (4, -4, 2))]
        found = min((simplex(lambda x: self.start(z, *self.shape(x))[2], s, size=1.0, steps=400) for s in starts), key=lambda r: r[1])
        self.alpha, self.beta, self.phi = self.shape(found[0])
        level, trend, sse = self.start(z, self.alpha, self.beta, self.phi)
        _, last, slope = self.errors(z, self.alpha, self.beta, self.phi, level, trend)
        self.sse, self.level, self.trend = sse * scale**2, last * scale + y[0], slope * scale
        return self

    def forecast(self, history: np.ndarray, horizon: int) -> np.ndarray:
        history = np.asarray(history, float)
        if len(history) < 6 or not np.std(history) > 0:
            return np.repeat(history[-1], horizon)
        self.fit(history)
        return self.level + self.trend * np.cumsum(self.phi ** np.arange(1, horizon + 1))
