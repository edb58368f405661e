"""Tail probabilities of t, F, chi-square and normal statistics (driver side, scalars only)."""

from __future__ import annotations

import math

_TINY = 1e-300
_STEPS = 1000
_EPS = 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + coef / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            value *= step
        if abs(step - 1.0) < _EPS:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        for _ in range(_STEPS):
            n += 1.0
            term *= x / n
            total += term
            if term < total * _EPS:
                break
        return 1.0 - total * scale
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    value = d
    for i in range(1, _STEPS):
        coef = -i * (i - a)
        b += 2.0
        d = 1.0 / ((coef * d + b) or _TINY)
        c = (b + coef / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < _EPS:
            break
    return scale * value


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f <= 0.0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return _gamma_upper(df / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
