"""Distribution tails for finished test statistics.

Applied to the handful of rows a test produces, never to data rows. Arrow-batched.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - s, 1e300
    d = value = 1.0 / b
    for i in range(1, 500):
        num = -i * (i - s)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided tail; from 100,000 degrees of freedom on by the normal tail at a corrected point, as gamma terms cancel there."""
    if dof > 1e5:
        w = math.sqrt((dof - 0.5) * math.log1p(t * t / dof))
        return math.erfc((w + (w**3 + 3.0 * w) / (48.0 * (dof - 0.5) ** 2)) / math.sqrt(2.0))
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """Upper quantile for p > 0.5, by bisection on the tail."""
    low, high = 0.0, 1.0
    while high < 1e300 and 1.0 - t_two_sided(high, dof) / 2.0 < p:
        low, high = high, 2.0 * high
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, dof) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series)],
                     dtype="float64")


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@pandas_udf(DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, dof)


@pandas_udf(DoubleType())
def t_critical(alpha: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(lambda a, d: t_quantile(1.0 - a / 2.0, d), alpha, dof)


@pandas_udf(DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(lambda v, d: gamma_upper(d / 2.0, v / 2.0), stat, dof)
