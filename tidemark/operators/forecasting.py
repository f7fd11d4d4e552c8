"""Forecasts from fit rows.  A fit row carries its newest values and residuals, so no data is re-read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions.guards import dot
from tidemark.functions.probability import z_value
from tidemark.layout import BY
from tidemark.operators import estimation, recursion
from tidemark.operators.cleaning import drop_missing
from tidemark.operators.shaping import number_rows

HORIZON_BLOCK = 1024


def _empty() -> Column:
    return F.array().cast("array<double>")


def _running(values: Column, start: Column) -> Column:
    """Running sums of a short array from ``start``."""
    folded = F.aggregate(values, F.struct(start.alias("v"), _empty().alias("out")), lambda s, x: F.struct(
        (s["v"] + x).alias("v"), F.concat(s["out"], F.array(s["v"] + x)).alias("out")))
    return folded["out"]


def arma_path(steps: int, phi="phi", theta="theta", y_tail="y_tail", e_tail="e_tail") -> Column:
    """Point forecasts of the centred process as an array; predictions feed back, future shocks are 0."""
    phi, theta = F.col(phi), F.col(theta)
    start = F.struct(F.slice(y_tail, F.lit(1), F.greatest(F.size(phi), F.lit(1))).alias("y"),
                     F.slice(e_tail, F.lit(1), F.greatest(F.size(theta), F.lit(1))).alias("e"), _empty().alias("out"))

    def step(s, _):
        value = dot(phi, F.slice(s["y"], F.lit(1), F.size(phi))) + dot(theta, F.slice(s["e"], F.lit(1), F.size(theta)))
        return F.aggregate(F.array(value), s, lambda t, f: F.struct(
            F.concat(F.array(f), t["y"]).alias("y"), F.concat(F.array(F.lit(0.0)), t["e"]).alias("e"),
            F.concat(t["out"], F.array(f)).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["out"]


def integrate(values: Column, levels="levels") -> Column:
    """Undo differencing of a forecast array, innermost difference first."""
    return F.aggregate(F.reverse(F.col(levels)), values, lambda f, level: _running(f, level))


def psi_weights(steps: int, phi="phi", theta="theta", levels="levels") -> Column:
    """Responses of the (integrated) process to one shock, lag 0 first."""
    phi, theta = F.col(phi), F.col(theta)

    def step(psi, k):
        seen = F.least(F.size(phi), F.size(psi))
        new = (F.coalesce(F.get(theta, k - 1), F.lit(0.0))
               + dot(F.slice(phi, F.lit(1), seen), F.slice(psi, F.lit(1), seen)))
        return F.concat(F.array(new), psi)

    lags = F.sequence(F.lit(1), F.lit(steps - 1)) if steps > 1 else F.array().cast("array<int>")
    psi = F.reverse(F.aggregate(lags, F.array(F.lit(1.0)), step))
    return F.aggregate(F.col(levels), psi, lambda p, _: _running(p, F.lit(0.0)))


def forecast_interval(steps: int, sigma2="sigma2") -> Column:
    """Standard error of each step from the psi weights."""
    squares = F.transform(psi_weights(steps), lambda v: v * v)
    return F.transform(_running(squares, F.lit(0.0)), lambda v: F.sqrt(v * F.col(sigma2)))


def with_forecast(fits: DataFrame, steps: int, alpha: float = 0.05) -> DataFrame:
    """Array columns ``predictions, lower_bound, upper_bound``; failed fits keep NULL arrays."""
    z = z_value(alpha)
    ok = F.col("success") if "success" in fits.columns else F.lit(True)
    points = integrate(F.transform(arma_path(steps), lambda f: f + F.col("mean")))
    d = fits.withColumns({"predictions": F.when(ok, points), "_s": F.when(ok, forecast_interval(steps))})
    return d.withColumns({
        "lower_bound": F.zip_with("predictions", "_s", lambda f, s: f - z * s),
        "upper_bound": F.zip_with("predictions", "_s", lambda f, s: f + z * s)}).drop("_s")


def forecast_rows(fits: DataFrame, steps: int, alpha: float = 0.05, by=BY) -> DataFrame:
    """``(by, step, forecast, lower, upper, status, engine_warnings)``; a failed fit gives NULL forecasts."""
    d = with_forecast(fits, steps, alpha)
    error = F.coalesce("error", F.lit("fit failed")) if "error" in fits.columns else F.lit("fit failed")
    status = F.when(F.col("predictions").isNotNull(), F.lit("ok")).otherwise(error)
    notes = F.coalesce("warnings", F.lit("")) if "warnings" in fits.columns else F.lit("")
    step = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    d = d.select(*by, step, "predictions", "lower_bound", "upper_bound", status.alias("status"),
                 notes.alias("engine_warnings"))
    at = lambda c, name: F.get(c, F.col("step") - 1).alias(name)
    return d.select(*by, F.col("step").cast("long").alias("step"), at("predictions", "forecast"),
                    at("lower_bound", "lower"), at("upper_bound", "upper"), "status", "engine_warnings")


def ar_forecast(df: DataFrame, p: int = 1, steps: int = 12, alpha: float = 0.05, by=BY, bounded: bool = False):
    return forecast_rows(estimation.fit_one(df, (p, 0, 0), by, bounded), steps, alpha, by)


def ma_forecast(df: DataFrame, q: int = 1, steps: int = 12, alpha: float = 0.05, by=BY, bounded: bool = False):
    """The last shocks carry q steps, then the mean."""
    return forecast_rows(estimation.fit_one(df, (0, 0, q), by, bounded), steps, alpha, by)


def arma_forecast(df: DataFrame, p=1, q=1, steps: int = 12, alpha: float = 0.05, by=BY, bounded: bool = False):
    return forecast_rows(estimation.fit_one(df, (p, 0, q), by, bounded), steps, alpha, by)


def arima_forecast(df: DataFrame, p=1, d=1, q=1, steps: int = 12, alpha: float = 0.05, by=BY, bounded: bool = False):
    return forecast_rows(estimation.fit_one(df, (p, d, q), by, bounded), steps, alpha, by)


def forecast_groups(df: DataFrame, order=(1, 0, 0), steps: int = 12, by=BY, bounded: bool = False) -> DataFrame:
    """One model per group, long form, with a row per step also for groups that could not be fitted."""
    return forecast_rows(estimation.fit_one(df, order, by, bounded), steps, by=by)


def predict_groups(df: DataFrame, order=(1, 1, 1), steps: int = 12, alpha: float = 0.05, by=BY,
                   bounded: bool = False) -> DataFrame:
    """Array form of the forecasts with bounds."""
    return with_forecast(estimation.fit_one(df, order, by, bounded), steps, alpha).select(
        *by, "success", "predictions", "lower_bound", "upper_bound", "error")


def predict_from_params(df: DataFrame, fits: DataFrame, steps: int = 12, alpha: float = 0.05, depth: int = 5,
                        d: int = 0, by=BY, bounded: bool = False) -> DataFrame:
    """Forecast stored parameters on given data: no refit."""
    return forecast_rows(recursion.with_tails(df, fits, depth, d, by, bounded), steps, alpha, by)


def model_forecast(fits: DataFrame, steps: int = 12, alpha: float = 0.05, by=BY) -> DataFrame:
    return forecast_rows(fits, steps, alpha, by).select(*by, "step", "forecast", "lower", "upper")


def log_back_transform(forecasts: DataFrame, columns=("forecast", "lower", "upper"), constant: str = "log_c") -> DataFrame:
    return forecasts.withColumns({c: F.exp(c) - F.col(constant) for c in columns})


def _block_path(by):
    names = [*by, "step", "forecast"]

    def blocks(batches):
        for pdf in batches:
            parts = []
            for r in pdf.itertuples(index=False):
                phi, theta = np.asarray(r.phi, dtype=float), np.asarray(r.theta, dtype=float)
                y, e = np.asarray(r.y_tail, dtype=float), np.asarray(r.e_tail, dtype=float)
                levels = np.asarray(r.levels, dtype=float)
                p, q, d = len(phi), len(theta), len(levels)
                # state: newest values, newest shocks, current level of each lower difference, constant
                a, b = max(p, 1), max(q, 1)
                size = a + b + d + 1
                move = np.zeros((size, size))
                move[0, :p], move[0, a:a + q] = phi, theta
                move[1:a, :a - 1] += np.eye(a - 1)
                move[a + 1:a + b, a:a + b - 1] += np.eye(b - 1)
                move[-1, -1] = 1.0
                for k in range(d - 1, -1, -1):  # level k grows by level k + 1 (or by the forecast itself)
                    inner = move[a + b + k + 1] if k < d - 1 else move[0] + r.mean * move[-1]
                    move[a + b + k] = inner
                    move[a + b + k, a + b + k] += 1.0
                s = np.zeros(size)
                s[:min(a, len(y))], s[a:a + min(b, len(e))] = y[:a], e[:b]
                s[a + b:a + b + d], s[-1] = levels, 1.0
                s = np.linalg.matrix_power(move, int(r.first)) @ s
                out = np.empty(int(r.last) - int(r.first))
                for i in range(len(out)):
                    s = move @ s
                    out[i] = s[a + b] if d else s[0] + r.mean
                part = pd.DataFrame({"step": np.arange(r.first + 1, r.last + 1), "forecast": out})
                for k in by:
                    part[k] = getattr(r, k)
                parts.append(part)
            if parts:
                yield pd.concat(parts)[names]

    return blocks


def forecast_long(fits: DataFrame, steps: str, by=BY) -> DataFrame:
    """Point forecasts for a horizon column of any length.

    The horizon is cut into blocks; each block jumps to its start by a matrix power, so a long horizon
    is many small tasks, not one array.
    """
    good = fits.filter(F.col("success") & (F.col(steps) > 0)).withColumn(
        "_blocks", F.expr(f"({steps} - 1) div {HORIZON_BLOCK} + 1"))
    first = F.col("_b") * HORIZON_BLOCK
    tasks = number_rows(good, "_blocks", "_k").withColumnRenamed("_k", "_b").select(
        *by, "phi", "theta", "y_tail", "e_tail", "levels", "mean", first.alias("first"),
        F.least(first + HORIZON_BLOCK, F.col(steps)).alias("last"))
    schema = T.StructType([fits.schema[k] for k in by]
                          + [T.StructField("step", T.LongType()), T.StructField("forecast", T.DoubleType())])
    return tasks.mapInPandas(_block_path(by), schema)
