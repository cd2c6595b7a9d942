"""Tail areas and quantiles of the t, F and studentised range distributions, for some scalars."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability of a t value at least this far from zero."""
    if not math.isfinite(t) or df <= 0:
        return math.nan
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=4096)
def t_quantile(probability: float, df: float) -> float:
    """Upper quantile (probability above one half) by bisection on the tail."""
    if df <= 0:
        return math.nan
    tail = 2.0 * (1.0 - probability)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def f_upper(f: float, df1: float, df2: float) -> float:
    """Probability of a larger F value."""
    if not math.isfinite(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    return beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


_erf = np.vectorize(math.erf, otypes=[float])


@lru_cache(maxsize=8)
def _legendre(points: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(points)


def _panels(low: float, high: float, panels: int, points: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of Gauss-Legendre quadrature on equal panels."""
    x, w = _legendre(points)
    edges = np.linspace(low, high, panels + 1)
    half = np.diff(edges)[:, None] / 2.0
    nodes = (edges[:-1, None] + half) + half * x
    return nodes.ravel(), (half * w).ravel()


def _range_cdf(width: np.ndarray, means: int) -> np.ndarray:
    """Probability that ``means`` standard normal values span at most ``width``."""
    z, weight = _panels(-8.5, 8.5, 6)
    density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * weight
    # the smallest of the values is at z, the others within width above it
    upto = 0.5 * (1.0 + _erf((z + width[:, None]) / math.sqrt(2.0)))
    inside = upto - 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))
    return means * (density * inside ** (means - 1)).sum(axis=1)


@lru_cache(maxsize=65536)
def studentised_range_upper(q: float, means: int, df: float) -> float:
    """Probability of a larger range of ``means`` means over an independent standard error.

    The range's distribution is averaged over that of the error, a scaled chi value with ``df``
    degrees of freedom, both by quadrature; infinite ``df`` leaves the range alone.
    """
    if not math.isfinite(q) or means < 2 or df <= 0:
        return math.nan
    if q <= 0.0:
        return 1.0
    if math.isinf(df):
        return max(0.0, 1.0 - float(_range_cdf(np.array([q]), means)[0]))
    spread = 10.0 / math.sqrt(2.0 * df)
    s, weight = _panels(max(0.0, 1.0 - spread), 1.0 + spread, 6)
    log_density = (
        math.log(2.0) + df / 2.0 * math.log(df / 2.0) - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    beyond = 1.0 - _range_cdf(q * s, means)
    return min(1.0, max(0.0, float((np.exp(log_density) * weight * beyond).sum())))
