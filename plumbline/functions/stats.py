"""Tails of distributions for single figures: normal, Student t and chi-squared with one degree."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return _NORMAL.cdf(z)


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def chi2_tail(x: float) -> float:
    """P(X >= x) of a chi-squared variable with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
