"""The chunked layout against the SQL of the same operators, and groups that cannot be fitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, VALUE
from tidemark.operators import cleaning, correlation, estimation, forecasting, recursion, stationarity
from tidemark.plans.queries.cleaning import positions
from tidemark.plans.queries.common import REGISTRY, query
from tidemark.plans.queries.models import stored_params
from tidemark.plans.series import USER


def _same(name: str) -> str:
    return REGISTRY[name][1]


@query("acf_chunked", _same("acf"))
def acf_chunked(t):
    return correlation.by_lag(correlation.acf(layout.add_chunk(t.hourly())), "acf")


@query("fill_linear_chunked", _same("fill_linear"))
def fill_linear_chunked(t):
    return positions(cleaning.fill_linear(layout.add_chunk(layout.with_index(t.dirty()))))


@query("kpss_test_chunked", _same("kpss_test"))
def kpss_test_chunked(t):
    return stationarity.kpss_test(layout.add_chunk(layout.with_index(t.ev_user())))


@query("arma_residuals_chunked", _same("arma_residuals"))
def arma_residuals_chunked(t):
    s = layout.add_chunk(layout.with_index(t.ev_user()))
    return recursion.arma_residuals(s, stored_params(t), 1).select(SERIES, IDX, "residual")


@query("ar_residuals_chunked", _same("ar_residuals"))
def ar_residuals_chunked(t):
    s = layout.add_chunk(layout.with_index(t.ev_user()))
    return recursion.ar_residuals(s, estimation.ar_fit(s, [1]), 1).select(SERIES, IDX, "residual", "fitted")


KIND = "series_id::BIGINT % 5"


def _with_gaps(t):
    """A fifth of the series has no value at all, a fifth five values only."""
    kind = F.col(SERIES).cast("long") % 5
    gone = (kind == 0) | ((kind == 1) & (F.col(IDX) >= 5))
    s = layout.with_index(t.ev_user())
    return s.withColumn(VALUE, F.when(~gone, F.col(VALUE))).drop(IDX)


GAPS = USER + f""", k AS (SELECT series_id, count(*) FILTER ({KIND} <> 0 AND NOT ({KIND} = 1 AND idx >= 5)) AS k FROM s GROUP BY 1)
"""


@query("forecast_groups_failures", GAPS + "SELECT series_id, step::BIGINT AS step, k < 10 AS failed FROM k, (SELECT unnest(range(1, 13)) AS step)")
def forecast_groups_failures(t):
    """A row per step for every series, whatever became of its fit."""
    f = forecasting.forecast_groups(_with_gaps(t), (1, 0, 0), 12)
    return f.select(SERIES, "step", (F.col("status") != "ok").alias("failed"))


@query("fit_groups_failures", GAPS + "SELECT series_id, k < 10 AS failed FROM k")
def fit_groups_failures(t):
    f = estimation.fit_groups(_with_gaps(t), (1, 0, 1))
    return f.select(SERIES, F.col("error").like("%short%").alias("short"), F.col("success"), F.col("error")).select(
        SERIES, (F.col("error").isNotNull() & (F.col("short") | F.col("error").like("%no values%"))).alias("failed"))


@query("ar_order_aic_failures", GAPS + "SELECT series_id, k < 10 AS failed FROM k WHERE k > 0")
def ar_order_aic_failures(t):
    """Every series with values has a row; those too short for any order have no order."""
    s = layout.with_index(cleaning.drop_missing(_with_gaps(t)))
    return estimation.ar_order_aic(s, 2).select(SERIES, F.col("p").isNull().alias("failed"))
