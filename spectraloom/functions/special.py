"""Distribution functions from incomplete gamma and beta integrals (no SciPy).

Continued fractions and series follow Abramowitz & Stegun, 6.5 and 26.5; quantiles are found by bisection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return scale * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = b + an / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * out


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def chi2_cdf(x: float, k: float) -> float:
    return gamma_p(k / 2, x / 2)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def t_cdf(x: float, k: float) -> float:
    tail = beta_i(k / 2, 0.5, k / (k + x * x)) / 2
    return 1 - tail if x > 0 else tail


def _quantile(cdf: Callable[[float], float], p: float) -> float:
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_ppf(p: float, k: float) -> float:
    return _quantile(lambda x: chi2_cdf(x, k), p)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _quantile(lambda x: f_cdf(x, d1, d2), p)


def t_ppf(p: float, k: float) -> float:
    return _quantile(lambda x: t_cdf(x, k), p) if p >= 0.5 else -t_ppf(1 - p, k)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)
