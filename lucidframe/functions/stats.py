"""Quantiles of distributions and small numeric rules, on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz's method)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return total


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function through the incomplete beta function, from the side that loses no digits."""
    a, b, outer = df / 2.0, 0.5, df / (df + t * t)
    inner = t * t / (df + t * t)  # one less `outer`, exact near zero
    if inner == 0.0 or outer == 0.0:
        return 0.5 if inner == 0.0 else float(t > 0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(outer) + b * math.log(inner))
    if outer < (a + 1.0) / (a + b + 2.0):
        tail = front * _beta_fraction(a, b, outer) / a
        return 1.0 - tail / 2.0 if t > 0 else tail / 2.0
    centre = front * _beta_fraction(b, a, inner) / b
    return 0.5 + math.copysign(centre, t) / 2.0


def t_quantile(p: float, df: float) -> float:
    """Inverse of t_cdf by bisection."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if t_cdf(middle, df) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def pareto(points: list[tuple[float, float]]) -> list[bool]:
    """Whether each point is on the frontier of two minimised axes; equal points all are."""
    return [not any(q[0] <= p[0] and q[1] <= p[1] and q != p for q in points) for p in points]
