"""Distribution functions for small result tables and quantile grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(stat: float, df: float) -> float:
    """P(|T| >= |stat|) for Student's t."""
    if df <= 0 or math.isnan(stat):
        return float("nan")
    # The incomplete beta loses digits from here on, where the normal tail agrees to 1e-8.
    if df > 1e8:
        return math.erfc(abs(stat) / math.sqrt(2))
    return incomplete_beta(df / 2, 0.5, df / (df + stat * stat))


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


@pandas_udf(DoubleType())
def t_p_value(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; meant for result tables of a few rows."""
    return pd.Series(
        [None if s is None or np.isnan(s) else t_two_sided(s, d) for s, d in zip(stat, df)], dtype="float64"
    )


# Acklam's rational approximation of the normal quantile (relative error 1.15e-9).
_NUM_CENTRAL = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
                1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_DEN_CENTRAL = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                6.680131188771972e01, -1.328068155288572e01)
_NUM_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_DEN_TAIL = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL_START = 0.02425


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_quantile(p: Column) -> Column:
    """Inverse normal distribution as a plain column expression."""
    def tail(q: Column) -> Column:
        r = F.sqrt(F.lit(-2.0) * F.ln(q))
        return _horner(_NUM_TAIL, r) / (_horner(_DEN_TAIL, r) * r + 1)

    q = p - 0.5
    r = q * q
    central = _horner(_NUM_CENTRAL, r) * q / (_horner(_DEN_CENTRAL, r) * r + 1)
    return (
        F.when(p < _TAIL_START, tail(p))
        .when(p > 1 - _TAIL_START, -tail(1 - p))
        .otherwise(central)
    )
