"""Distribution tails as columns; Arrow batches only where no closed form exists (result rows only)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Acklam's rational approximation of the normal quantile (numerators, denominators).
CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687,
              138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866,
              66.80131188771972, -13.28068155288572, 1.0)
TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996,
            3.754408661907416, 1.0)
TAIL_FROM = 0.02425
# Hart's rational approximation of the normal distribution function, as published by West.
NORMAL_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
              112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
              296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NORMAL_FAR = 7.07106781186547
NORMAL_ROOT = 2.506628274631


def z_value(alpha: float) -> float:
    """Two-sided normal critical value, computed once when the plan is built."""
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_quantile(p: Column) -> Column:
    r = p - 0.5
    centre = r * _poly(CENTRE_NUM, r * r) / _poly(CENTRE_DEN, r * r)
    low = F.sqrt(-2.0 * F.ln(p))
    high = F.sqrt(-2.0 * F.ln(1.0 - p))
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < TAIL_FROM, _poly(TAIL_NUM, low) / _poly(TAIL_DEN, low))
            .when(p > 1 - TAIL_FROM, -_poly(TAIL_NUM, high) / _poly(TAIL_DEN, high))
            .otherwise(centre))


def chi2_tail_even(x: Column, df: int) -> Column:
    """P(chi-square with an even number of degrees of freedom > x), a finite sum."""
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * x / 2.0 / float(i)
        total = total + term
    return F.exp(-x / 2.0) * total


def _chi2_tail(x: float, df: float) -> float:
    if x != x or df != df or df < 1:
        return math.nan
    half, k = x / 2.0, int(df)
    if k % 2 == 0:
        term = total = 1.0
        for i in range(1, k // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    tail, term = math.erfc(math.sqrt(half)), math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
    for i in range(1, (k + 1) // 2):
        tail += term
        term *= half / (i + 0.5)
    return min(1.0, tail)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_chi2_tail(a, b) for a, b in zip(x.astype(float), df.astype(float))], dtype=float)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function to about 1e-15, by a rational approximation."""
    x = F.abs(z)
    bell = F.exp(-x * x / 2.0)
    near = bell * _poly(NORMAL_NUM, x) / _poly(NORMAL_DEN, x)
    far = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + k / far
    tail = F.when(x > 37, 0.0).when(x < NORMAL_FAR, near).otherwise(bell / far / NORMAL_ROOT)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def _kolmogorov(d: float, n: float) -> float:
    if d != d or n != n:
        return math.nan
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


@F.pandas_udf(T.DoubleType())
def kolmogorov_tail(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_kolmogorov(a, b) for a, b in zip(d.astype(float), n.astype(float))], dtype=float)
