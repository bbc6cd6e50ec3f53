"""Maximum likelihood of tails above 1 from the means of their statistics.

Each function returns the coefficients of the log density in 1, y = ln x, y^2 and x.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def climbed(value: Callable[[np.ndarray], float], slope: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 500) -> np.ndarray:
    """A maximum of a smooth function by damped Newton steps; the second derivatives are differences of ``slope``."""
    at, now, damping = np.array(start, float), value(np.array(start, float)), 1e-4
    for _ in range(steps):
        g = slope(at)
        h = np.empty((len(at), len(at)))
        for k in range(len(at)):
            e = np.zeros(len(at))
            e[k] = 1e-5 * max(1.0, abs(at[k]))
            h[k] = (slope(at + e) - slope(at - e)) / (2 * e[k])
        h = (h + h.T) / 2
        moved = False
        while damping < 1e12:
            # Shifted until it is a descent of the negative.
            lowest = np.linalg.eigvalsh(-h).min()
            step = np.linalg.solve(-h + (damping + max(0.0, 1e-9 - lowest)) * np.eye(len(at)), g)
            then = value(at + step)
            if then >= now:
                moved = then - now > 1e-15 * max(1.0, abs(now))
                at, now, damping = at + step, then, damping / 10
                break
            damping *= 10
        if not moved:
            break
    return at


def exponential(mean_x: float) -> np.ndarray:
    rate = 1 / (mean_x - 1)
    return np.array([math.log(rate) + rate, 0.0, 0.0, -rate])


def log_erfc(x: float) -> float:
    if x < 20:
        return math.log(math.erfc(x))
    t = 1 / (2 * x * x)
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-t + 3 * t * t - 15 * t**3)


def lognormal(mean_y: float, mean_yy: float) -> np.ndarray:
    """Of x >= 1: y is a normal variable cut off at 0."""

    def value(p: np.ndarray) -> float:
        mu, sigma = p[0], math.exp(p[1])
        return -p[1] - (mean_yy - 2 * mu * mean_y + mu * mu) / (2 * sigma * sigma) - log_erfc(-mu / sigma / math.sqrt(2))

    def slope(p: np.ndarray) -> np.ndarray:
        mu, sigma = p[0], math.exp(p[1])
        z = -mu / sigma
        hazard = math.exp(-z * z / 2 - log_erfc(z / math.sqrt(2))) * math.sqrt(2 / math.pi)
        square = mean_yy - 2 * mu * mean_y + mu * mu
        return np.array([(mean_y - mu) / sigma**2 - hazard / sigma, -1 + square / sigma**2 - hazard * z])

    mu, tau = climbed(value, slope, np.array([mean_y, math.log(max(mean_yy - mean_y**2, 1e-12)) / 2]))
    sigma = math.exp(tau)
    constant = -tau - 0.5 * math.log(math.pi / 2) - mu * mu / (2 * sigma * sigma) - log_erfc(-mu / sigma / math.sqrt(2))
    return np.array([constant, mu / sigma**2 - 1, -1 / (2 * sigma * sigma), 0.0])


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def cutoff_moments(alpha: float, rate: float) -> tuple[float, float, float]:
    """ln of the integral of x^-alpha exp(-rate (x - 1)) over x >= 1, and the means of ln x and x under it."""
    log_g = lambda u: (1 - alpha) * u - rate * np.expm1(u)  # noqa: E731  in u = ln x
    top = 1.0
    while log_g(top) > -45 or (1 - alpha) - rate * math.exp(min(top, 700)) > 0:
        top *= 1.5
    edges = np.concatenate([[0.0], np.geomspace(top * 1e-6, top, 160)])
    half, middle = np.diff(edges)[:, None] / 2, (edges[1:] + edges[:-1])[:, None] / 2
    u = (middle + half * _NODES).ravel()
    most = float(log_g(u).max())
    w = (half * _WEIGHTS).ravel() * np.exp(log_g(u) - most)
    total = w.sum()
    return most + math.log(total), float((w * u).sum() / total), float((w * np.exp(u)).sum() / total)


def truncated_power_law(mean_y: float, mean_x: float, alpha: float) -> np.ndarray:
    """Of x >= 1: x^-alpha exp(-rate x), from the plain power law's ``alpha``; the rate is above 0."""

    def value(p: np.ndarray) -> float:
        rate = math.exp(p[1])
        return -p[0] * mean_y - rate * (mean_x - 1) - cutoff_moments(p[0], rate)[0]

    def slope(p: np.ndarray) -> np.ndarray:
        rate = math.exp(p[1])
        _, y, x = cutoff_moments(p[0], rate)
        return np.array([y - mean_y, rate * (x - mean_x)])

    a, log_rate = climbed(value, slope, np.array([alpha, math.log(0.1 / max(mean_x, 1.0))]))
    rate = math.exp(log_rate)
    return np.array([rate - cutoff_moments(a, rate)[0], -a, 0.0, -rate])
