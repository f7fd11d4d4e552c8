"""Residual diagnostics.  Input: indexed rows ``(series, idx, residual[, fitted])``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.functions.probability import chi2_tail, chi2_tail_even, kolmogorov_tail, normal_cdf, normal_quantile
from tidemark.layout import BY, IDX

R = "residual"
TINY = 1e-15
LJUNG_LAGS = 10

# Royston's polynomial coefficients for the Shapiro-Wilk weights and p-value.
ROYSTON_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
ROYSTON_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
ROYSTON_SMALL_G = (0.459, -2.273)
ROYSTON_SMALL_MU = (-0.0006714, 0.025054, -0.39978, 0.5440)
ROYSTON_SMALL_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)
ROYSTON_LARGE_MU = (0.0038915, -0.083751, -0.31082, -1.5861)
ROYSTON_LARGE_SD = (0.0030302, -0.082676, -0.4803)


def residual_stats(df: DataFrame, by=BY) -> DataFrame:
    """Mean, population deviation, skewness and excess kurtosis; no variation gives 0 shape."""
    g = df.groupBy(*by).agg(F.count(R).alias("n"), F.avg(R).alias("mean"), F.stddev_pop(R).alias("std"),
                            F.skewness(R).alias("_sk"), F.kurtosis(R).alias("_ku"))
    flat = (F.col("n") < 2) | (F.col("std") < TINY)
    return g.select(*by, "n", "mean", "std", F.when(flat, 0.0).otherwise(F.col("_sk")).alias("skewness"),
                    F.when(flat, 0.0).otherwise(F.col("_ku")).alias("kurtosis"))


def jarque_bera(df: DataFrame, by=BY, stats: DataFrame | None = None) -> DataFrame:
    s = residual_stats(df, by) if stats is None else stats
    stat = F.when((F.col("n") >= 2) & (F.col("std") >= TINY), F.col("n") / 6.0 * (
        F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0))
    return s.select(*by, stat.alias("jb_stat"), F.exp(-stat / 2.0).alias("jb_p"))


def ks_normal(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal with the sample's mean and deviation."""
    r = df.select(*by, R).filter(F.col(R).isNotNull())
    wide = layout.needs_chunks(df, by, bounded)
    s = layout.with_index(r, by, (R,), bounded=not wide)
    s = layout.with_totals(s, by, n=F.count("*"), _m=F.avg(R), _s=F.stddev_pop(R))
    s = s.filter((F.col("n") >= 3) & (F.col("_s") >= TINY)).withColumn(
        "_p", normal_cdf((F.col(R) - F.col("_m")) / F.col("_s")))
    gap = F.greatest((F.col(IDX) + 1) / F.col("n") - F.col("_p"), F.col("_p") - F.col(IDX) / F.col("n"))
    g = s.groupBy(*by).agg(F.max("n").alias("n"), F.max(gap).alias("ks_stat"))
    return g.select(*by, "ks_stat", kolmogorov_tail("ks_stat", "n").alias("ks_p"))


def _at(coefs, x) -> Column:
    """A polynomial, highest power first; coefficients may be columns."""
    acc = F.lit(coefs[0]) if isinstance(coefs[0], float) else coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def shapiro_wilk(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """W and p of any number of residuals from 3 up; fewer, or no variation, give NULL.

    W needs the sorted positions, the normal quantile of each and a few sums: one sort and one aggregate, so
    a series of any length is no single group.
    """
    r = df.select(*by, R).filter(F.col(R).isNotNull())
    wide = layout.needs_chunks(df, by, bounded)
    s = layout.with_index(r, by, (R,), bounded=not wide)
    share = lambda i: (i - 0.375) / (F.col("n") + 0.25)
    s = layout.with_totals(s, by, n=F.count("*")).filter("n >= 3").withColumn("_p", share(F.col(IDX) + 1))
    s = s.withColumn("_q", normal_quantile(F.col("_p")))
    m, x = F.col("_q"), F.col(R)
    at = lambda i: F.max(F.when(F.col(IDX) == i - 1, x))
    g = s.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(m * m).alias("mm"), F.sum(m * x).alias("mx"), (F.var_pop(x) * F.count("*")).alias("ss"),
        F.stddev_pop(x).alias("sd"), at(1).alias("x1"), at(2).alias("x2"), at(F.col("n") - 1).alias("y2"), at(F.col("n")).alias("y1"))
    n, mm, top, second_top, last, second, w = (F.col(c) for c in ("n", "mm", "top", "second_top", "last", "second", "shapiro_stat"))
    # one step per line of the published method; each is a projection of its own, so expressions stay small
    g = g.withColumns({"_p1": share(n), "_p2": share(n - 1), "u": 1.0 / F.sqrt(n)})
    g = g.withColumns({"top": normal_quantile(F.col("_p1")), "second_top": normal_quantile(F.col("_p2"))})
    g = g.withColumns({"last": _at((*ROYSTON_LAST, top / F.sqrt(mm)), F.col("u")), "second": _at((*ROYSTON_NEXT, second_top / F.sqrt(mm)), F.col("u")),
                       "ends": F.col("y1") - F.col("x1"), "inner": F.col("y2") - F.col("x2")})
    g = g.withColumn("rest", F.col("mx") - top * F.col("ends"))
    long = last * F.col("ends") + second * F.col("inner") + (F.col("rest") - second_top * F.col("inner")) / F.sqrt(
        (mm - 2 * top * top - 2 * second_top * second_top) / (1 - 2 * last * last - 2 * second * second))
    short = last * F.col("ends") + F.col("rest") / F.sqrt((mm - 2 * top * top) / (1 - 2 * last * last))
    g = g.withColumn("weighted", F.when(n == 3, F.col("ends") * math.sqrt(0.5)).when(n > 5, long).otherwise(short))
    usable = (n >= 3) & (F.col("sd") >= TINY) & (F.col("ends") >= TINY)
    g = g.select(*by, "n", F.when(usable, F.least(F.lit(1.0), div(F.col("weighted") * F.col("weighted"), F.col("ss")))).alias("shapiro_stat"))
    g = g.withColumns({"y": F.ln(F.greatest(1.0 - w, F.lit(1e-300))), "ln": F.ln(n.cast("double")), "edge": _at(ROYSTON_SMALL_G, n)})
    few = (-F.ln(F.greatest(F.col("edge") - F.col("y"), F.lit(1e-300))) - _at(ROYSTON_SMALL_MU, n)) / F.exp(_at(ROYSTON_SMALL_SD, n))
    many = (F.col("y") - _at(ROYSTON_LARGE_MU, F.col("ln"))) / F.exp(_at(ROYSTON_LARGE_SD, F.col("ln")))
    g = g.withColumn("z", F.when(n <= 11, few).otherwise(many))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    p = (F.when(w.isNull(), F.lit(None).cast("double")).when(n == 3, three)
         .when((n <= 11) & (F.col("y") >= F.col("edge")), 1e-99).otherwise(normal_cdf(-F.col("z"))))
    found = g.select(*by, "shapiro_stat", p.alias("shapiro_p"))
    return df.select(*by).distinct().join(found, [*by], "left")


def lag_correlations(df: DataFrame, lags: int = LJUNG_LAGS, by=BY, bounded: bool = False) -> DataFrame:
    """``(by, n, r[1..lags])``: Pearson between the series and itself shifted, each side with its own mean."""
    s = layout.with_lags(layout.with_index(df, by, bounded=bounded), R, lags, by)
    aggs = []
    for k in range(1, lags + 1):
        there = F.when(F.col(f"lag_{k}").isNotNull(), F.col(R))
        aggs += [F.covar_pop(there, F.col(f"lag_{k}")).alias(f"c{k}"), F.stddev_pop(there).alias(f"a{k}"),
                 F.stddev_pop(f"lag_{k}").alias(f"b{k}")]
    g = s.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    corr = lambda k: F.when((F.col(f"a{k}") >= TINY) & (F.col(f"b{k}") >= TINY),
                            div(F.col(f"c{k}"), F.col(f"a{k}") * F.col(f"b{k}"))).otherwise(0.0)
    return g.select(*by, "n", F.array(*[F.coalesce(corr(k), F.lit(0.0)) for k in range(1, lags + 1)]).alias("r"))


def lag_correlation(df: DataFrame, lags: int = LJUNG_LAGS, by=BY, bounded: bool = False) -> DataFrame:
    c = lag_correlations(df, lags, by, bounded)
    return c.select(*by, F.posexplode("r").alias("lag", "r")).withColumn("lag", (F.col("lag") + 1).cast("long"))


def _depth() -> Column:
    return F.least(F.lit(LJUNG_LAGS), F.floor(F.col("n") / 4))


def ljung_box(df: DataFrame, by=BY, bounded: bool = False, correlations: DataFrame | None = None) -> DataFrame:
    """n(n+2) sum r_k^2/(n-k) over ``min(10, n div 4)`` lags; closed-form p where all ten are used."""
    c = lag_correlations(df, LJUNG_LAGS, by, bounded) if correlations is None else correlations
    total = F.lit(0.0)
    for k in range(1, LJUNG_LAGS + 1):
        total = total + F.when(_depth() >= k, F.pow(F.col("r")[k - 1], F.lit(2.0)) / (F.col("n") - k)).otherwise(0.0)
    stat = F.col("n") * (F.col("n") + 2) * total
    c = c.select(*by, stat.alias("lb_stat"), _depth().cast("long").alias("lb_lags"))
    p = F.when(F.col("lb_lags") == LJUNG_LAGS, chi2_tail_even(F.col("lb_stat"), LJUNG_LAGS)).otherwise(
        F.nanvl(chi2_tail("lb_stat", F.col("lb_lags").cast("double")), F.lit(None).cast("double")))
    return c.withColumn("lb_p", p)


def residual_acf_pass(df: DataFrame, by=BY, bounded: bool = False, correlations: DataFrame | None = None) -> DataFrame:
    """At most two of the lags stick out of +-1.96/sqrt(n)."""
    c = lag_correlations(df, LJUNG_LAGS, by, bounded) if correlations is None else correlations
    out = F.size(F.filter(F.slice("r", F.lit(1), _depth().cast("int")),
                          lambda v: F.abs(v) > 1.96 / F.sqrt(F.greatest(F.col("n"), F.lit(1)))))
    return c.select(*by, out.cast("long").alias("acf_peaks"), (out <= 2).alias("acf_pass"))


def breusch_pagan(df: DataFrame, by=BY) -> DataFrame:
    """LM test of squared residuals on fitted values."""
    sq = F.col(R) * F.col(R)
    g = df.groupBy(*by).agg(F.count(R).alias("n"), F.regr_r2(sq, F.col("fitted")).alias("bp_r2"))
    stat = F.col("n") * F.col("bp_r2")
    g = g.select(*by, "bp_r2", stat.alias("bp_stat"))
    return g.withColumn("bp_p", F.nanvl(chi2_tail("bp_stat", F.lit(1.0)), F.lit(None).cast("double")))


def residual_report(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Every diagnostic of a series in one row."""
    s = layout.with_index(df, by, bounded=bounded)
    c = lag_correlations(s, LJUNG_LAGS, by)
    stats = residual_stats(s, by)
    out = stats.join(jarque_bera(s, by, stats), [*by]).join(ljung_box(s, by, correlations=c), [*by])
    out = out.join(residual_acf_pass(s, by, correlations=c), [*by])
    out = out.join(ks_normal(s, by), [*by], "left").join(shapiro_wilk(s, by), [*by], "left")
    return out.join(breusch_pagan(s, by), [*by], "left") if "fitted" in df.columns else out


def pass_rates(diagnostics: DataFrame, by=BY) -> DataFrame:
    """Share of successful windows that pass, per test."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    return diagnostics.filter("success").groupBy(*by).agg(
        share("overall_pass"), share("ljung_box_pass"), share("acf_pass"))
