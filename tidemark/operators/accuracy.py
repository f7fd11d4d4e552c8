"""Forecast accuracy.  Input: ``(series, step, actual, predicted)`` as ``align_actual`` gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions import criteria
from tidemark.functions.guards import INFINITY, div
from tidemark.layout import BY, IDX

A, P = "actual", "predicted"


def _error() -> Column:
    return F.col(A) - F.col(P)


def _one(df: DataFrame, by, **aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def _rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def _mae() -> Column:
    return F.avg(F.abs(_error()))


def _mape() -> Column:
    share = F.avg(F.when(F.col(A) != 0, F.abs(div(_error(), F.col(A))))) * 100
    return F.coalesce(share, F.lit(INFINITY))


def _smape() -> Column:
    return F.coalesce(F.avg(div(2.0 * F.abs(_error()), F.abs(A) + F.abs(P))) * 100, F.lit(INFINITY))


def _theil() -> Column:
    size = F.sqrt(F.avg(F.col(A) * F.col(A))) + F.sqrt(F.avg(F.col(P) * F.col(P)))
    return F.coalesce(div(_rmse(), size), F.lit(INFINITY))


def _mase() -> Column:
    naive = F.coalesce(F.avg(F.coalesce(F.abs(F.col(A) - F.col("_naive")), F.lit(0.0))), F.lit(0.0))
    return F.when(naive > 0, div(_mae(), naive)).when(_mae() > 0, INFINITY).otherwise(0.0)


def _direction() -> Column:
    same = (F.col(A) > F.col("_a")) == (F.col(P) > F.col("_p"))
    return F.coalesce(F.avg(same.cast("int")), F.lit(0.0))


def _stepped(df: DataFrame, by, seasonal: str | None = None) -> DataFrame:
    """Previous actual and predicted value next to each row."""
    s = df if IDX in df.columns else df.withColumnRenamed("step", IDX)
    rows, w, finish = layout.neighbourhood(s, back=1, by=by)
    s = finish(rows.withColumns({"_a": F.lag(A).over(w), "_p": F.lag(P).over(w)}))
    return s.withColumn("_naive", F.col(seasonal) if seasonal else F.col("_a"))


def rmse(df, by=BY) -> DataFrame:
    return _one(df, by, rmse=_rmse())


def mae(df, by=BY) -> DataFrame:
    return _one(df, by, mae=_mae())


def mape(df, by=BY) -> DataFrame:
    """Percent over rows with a non-zero actual; infinite when there are none."""
    return _one(df, by, mape=_mape())


def smape(df, by=BY) -> DataFrame:
    return _one(df, by, smape=_smape())


def mase(df, seasonal: str | None = None, by=BY) -> DataFrame:
    """Against the previous value (the first against itself) or a seasonal forecast column."""
    return _one(_stepped(df, by, seasonal), by, mase=_mase())


def theil_u(df, by=BY) -> DataFrame:
    return _one(df, by, theil_u=_theil())


def directional_accuracy(df, by=BY) -> DataFrame:
    return _one(_stepped(df, by), by, directional_accuracy=_direction())


def evaluate_forecast(df, by=BY) -> DataFrame:
    """All seven measures from one aggregate."""
    return _one(_stepped(df, by), by, rmse=_rmse(), mae=_mae(), mape=_mape(), smape=_smape(), mase=_mase(),
                theil_u=_theil(), directional_accuracy=_direction())


def information_criteria(fits: DataFrame, by=BY) -> DataFrame:
    """All four criteria from log-likelihood, parameter count and observations."""
    ll, n, k = F.col("log_likelihood"), F.col("n_obs"), F.col("p") + F.col("q") + 1
    return fits.select(*by, "p", "d", "q", criteria.aic(ll, k).alias("aic"), criteria.bic(ll, k, n).alias("bic"),
                       criteria.aicc(ll, k, n).alias("aicc"), criteria.hqic(ll, k, n).alias("hqic"))


def forecast_distance(pairs: DataFrame, by=BY) -> DataFrame:
    """How far two aligned forecasts (``forecast_a``, ``forecast_b``) are apart."""
    gap = F.col("forecast_a") - F.col("forecast_b")
    return pairs.groupBy(*by).agg(
        F.avg(F.abs(gap)).alias("mae_diff"), F.sqrt(F.avg(gap * gap)).alias("rmse_diff"),
        (F.avg(F.abs(gap) / F.greatest(F.abs("forecast_a"), F.lit(1e-12))) * 100).alias("mape_diff"))


def relative_deviation(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.col("forecast_b") - F.col("forecast_a"))
    return pairs.withColumn("deviation_pct", 100.0 * gap / F.greatest(F.abs("forecast_a"), F.lit(1e-12)))


def forecast_agreement(pairs: DataFrame, by=BY) -> DataFrame:
    """Percent agreement per series, averaged over the series."""
    per = pairs.groupBy(*by).agg(
        F.avg(F.abs(F.col("forecast_a") - F.col("forecast_b"))).alias("gap"),
        F.greatest(F.avg(F.abs("forecast_a")), F.lit(1e-12)).alias("size"))
    score = 100.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("gap") / F.col("size")))
    return per.agg(F.avg(score).alias("agreement_pct"), F.count("*").alias("num_series"))
