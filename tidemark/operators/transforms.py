"""Fit, transform, inverse.  Fitted state is a small per-series table or columns next to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators import shaping


def diff_transform(df: DataFrame, order: int = 1, by=BY, bounded: bool = False):
    """``(differenced rows, state)``; pass both to ``inverse_diff``."""
    s = layout.with_index(df, by, bounded=bounded)
    return shaping.difference(s, order, by), first_levels(s, order, by)


def first_levels(s: DataFrame, order: int, by=BY) -> DataFrame:
    """What cumulation has to start from to give the series back: the values just before each difference."""
    lagged = layout.with_lags(s, VALUE, max(order - 1, 1), by)
    pick = [F.max(F.when(F.col(IDX) == order - 1, shaping._difference(k))) for k in range(order)]
    return lagged.groupBy(*by).agg(F.array(*pick).alias("levels"))


def inverse_diff(diffs: DataFrame, state: DataFrame, order: int = 1, by=BY) -> DataFrame:
    return shaping.undifference(diffs, state, order, by)


def log_state(df: DataFrame, constant: float | None = None, by=BY) -> DataFrame:
    low = F.min(VALUE)
    shift = F.lit(float(constant)) if constant is not None else -low + 1e-6
    return df.groupBy(*by).agg(F.when(low <= 0, shift).otherwise(0.0).alias("log_c"))


def log_transform(df: DataFrame, constant: float | None = None, by=BY, bounded: bool = False) -> DataFrame:
    """``ln(y + c)`` with the fitted ``log_c`` next to each row."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, _lo=F.min(VALUE))
    shift = F.lit(float(constant)) if constant is not None else -F.col("_lo") + 1e-6
    s = s.withColumn("log_c", F.when(F.col("_lo") <= 0, shift).otherwise(0.0)).drop("_lo")
    return s.withColumn(VALUE, F.ln(F.col(VALUE) + F.col("log_c")))


def inverse_log(df: DataFrame) -> DataFrame:
    return df.withColumn(VALUE, F.exp(VALUE) - F.col("log_c"))


def _boxcox(y: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.ln(y)).otherwise(div(F.pow(y, lam) - 1.0, lam))


def _best_lambda(lambdas) -> Column:
    scored = F.array(*[F.struct(
        ((lam - 1.0) * F.col("ln_sum") - F.col("n") / 2.0 * F.ln(F.col(f"v{i}"))).alias("llf"),
        (-F.abs(lam)).alias("small"), lam.alias("lam")) for i, lam in enumerate(lambdas)])
    usable = F.filter(scored, lambda s: s["llf"].isNotNull() & (s["llf"] < float("inf")) & ~F.isnan(s["llf"]))
    return F.array_max(usable)["lam"]


def boxcox_lambda(df: DataFrame, by=BY, refine: bool = True, bounded: bool = False) -> DataFrame:
    """Maximum-likelihood lambda on a grid -2..2 step 0.1, then +-0.1 step 0.01.  Positive series only.

    Each grid is one aggregate with a variance per candidate: no join with a candidate table.
    """
    coarse = [F.lit(round(-2.0 + 0.1 * i, 10)) for i in range(41)]
    y = F.col(VALUE)

    def score(rows, lambdas, extra):
        g = rows.groupBy(*by, *extra).agg(
            F.count("*").alias("n"), F.min(VALUE).alias("lo"), F.sum(F.ln(y)).alias("ln_sum"),
            *[F.var_pop(_boxcox(y, lam)).alias(f"v{i}") for i, lam in enumerate(lambdas)])
        return g.filter("lo > 0").select(*by, _best_lambda(lambdas).alias("lambda"))

    first = score(df.filter(y > 0), coarse, [])
    positive = df.groupBy(*by).agg(F.min(VALUE).alias("_lo")).filter("_lo > 0").drop("_lo")
    first = first.join(positive, [*by])
    if not refine:
        return first
    s = layout.with_index(df, by, bounded=bounded)
    rows = layout.join_series(s, first.withColumnRenamed("lambda", "_l"), by).filter(y > 0)
    fine = [F.col("_l") + round(-0.1 + 0.01 * i, 10) for i in range(21)]
    return score(rows, fine, ["_l"])


def boxcox_transform(df: DataFrame, lam: float | None = None, by=BY, bounded: bool = False) -> DataFrame:
    """Series with a value at or below 0 come back as rows with NULL and an error text."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, _lo=F.min(VALUE))
    if lam is None:
        fitted = boxcox_lambda(s, by)
        everyone = s.groupBy(*by).agg(F.count("*").alias("_n")).drop("_n")
        s = layout.join_series(s, everyone.join(fitted, [*by], "left"), by)
    else:
        s = s.withColumn("lambda", F.lit(float(lam)))
    ok = F.col("_lo") > 0
    s = s.withColumn("error", F.when(~ok, F.lit("Box-Cox needs positive values")))
    return s.withColumn(VALUE, F.when(ok, _boxcox(F.when(ok, F.col(VALUE)), F.col("lambda")))).drop("_lo")


def inverse_boxcox(df: DataFrame) -> DataFrame:
    lam, y = F.col("lambda"), F.col(VALUE)
    return df.withColumn(VALUE, F.when(F.abs(lam) < 1e-12, F.exp(y)).otherwise(
        F.pow(lam * y + 1.0, div(F.lit(1.0), lam))))


def standard_scale(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """``(y - mean) / std``; a constant series keeps its rows with NULL and an error text."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by,
                           scale_mean=F.avg(VALUE), scale_std=F.stddev_pop(VALUE))
    bad = F.coalesce(F.col("scale_std"), F.lit(0.0)) == 0
    return (s.withColumn(VALUE, div(F.col(VALUE) - F.col("scale_mean"), F.col("scale_std")))
            .withColumn("error", F.when(bad, F.lit("constant series cannot be scaled"))))


def inverse_standard(df: DataFrame) -> DataFrame:
    return df.withColumn(VALUE, F.col(VALUE) * F.col("scale_std") + F.col("scale_mean"))


def minmax_scale(df: DataFrame, low: float = 0.0, high: float = 1.0, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by,
                           scale_min=F.min(VALUE), scale_max=F.max(VALUE))
    span = F.col("scale_max") - F.col("scale_min")
    return (s.withColumn(VALUE, div(F.col(VALUE) - F.col("scale_min"), span) * (high - low) + low)
            .withColumn("error", F.when(F.coalesce(span, F.lit(0.0)) == 0, F.lit("constant series cannot be scaled"))))


def inverse_minmax(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    share = (F.col(VALUE) - low) / (high - low)
    return df.withColumn(VALUE, share * (F.col("scale_max") - F.col("scale_min")) + F.col("scale_min"))
