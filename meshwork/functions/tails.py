"""Tail probabilities on plain numbers, used on small result tables."""

from __future__ import annotations

import math


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 20_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials with chance p."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return beta_cdf(n - k, k + 1, 1.0 - p)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def hypergeometric_upper(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) when ``drawn`` items are taken from ``total`` of which ``marked`` are marked."""

    def log_choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    whole = log_choose(total, drawn)
    most = min(marked, drawn)
    return min(1.0, sum(math.exp(log_choose(marked, i) + log_choose(total - marked, drawn - i) - whole) for i in range(max(k, drawn + marked - total, 0), most + 1)))
