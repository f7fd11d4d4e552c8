"""Information criteria and the Gaussian conditional log-likelihood as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.guards import div

LOG_2PI = math.log(2.0 * math.pi)


def loglik(n: Column, rss: Column, sigma2: Column) -> Column:
    return -n / 2.0 * LOG_2PI - n / 2.0 * F.ln(sigma2) - div(rss, 2.0 * sigma2)


def aic(ll: Column, k: Column) -> Column:
    return 2.0 * k - 2.0 * ll


def bic(ll: Column, k: Column, n: Column) -> Column:
    return k * F.ln(n) - 2.0 * ll


def aicc(ll: Column, k: Column, n: Column) -> Column:
    """Infinite where the correction has no positive denominator."""
    spare = n - k - 1
    return F.when(spare > 0, aic(ll, k) + div(2.0 * k * (k + 1), spare)).otherwise(F.lit(float("inf")))


def hqic(ll: Column, k: Column, n: Column) -> Column:
    return 2.0 * k * F.ln(F.ln(n)) - 2.0 * ll
