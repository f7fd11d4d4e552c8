"""Residuals, fitted values and likelihood of given parameters.

The moving-average recursion runs through the whole series.  Short series are filtered by one Arrow
task each.  In a chunked layout every chunk is filtered alone from zero, which shows what it does to the state it
starts from: an affine map, a small matrix and a vector.  Maps of neighbours compose, so a prefix scan gives every chunk its true
start: blocks of ``FAN`` maps are composed level by level on the way up, and states are handed to the children on the way
down.  No group holds more than ``FAN`` chunks or blocks of a series, up to FAN^3 chunks.  Series of one chunk start from zeros and are not
scanned.  A second pass then filters each chunk from its true state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions import criteria
from tidemark.layout import BY, CHUNK, IDX, VALUE
from tidemark.operators import kernels, shaping


def ar_residuals(df: DataFrame, fits: DataFrame, order: int, by=BY, bounded: bool = False) -> DataFrame:
    """Autoregressive residuals by lag columns alone; the first ``order`` rows are 0."""
    s = layout.with_index(df, by, bounded=bounded)
    s = layout.join_series(s, fits.select(*by, "phi", "mean"), by)
    rows = layout.with_lags(s.withColumn("_w", F.col(VALUE) - F.col("mean")), "_w", order, by)
    guess = F.lit(0.0)
    for k in range(1, order + 1):
        guess = guess + F.get("phi", F.lit(k - 1)) * F.col(f"lag_{k}")
    e = F.when(F.col(IDX) >= order, F.col("_w") - guess).otherwise(0.0)
    return rows.select(*layout.keys(s, by), IDX, VALUE, e.alias("residual"), (F.col(VALUE) - e).alias("fitted"))


def _inputs(columns: dict, phi, theta, lags: int):
    """The filter input of one ordered piece: y minus its autoregression, 0 at the series start."""
    u = columns["_w"].astype(float)
    for k in range(1, min(lags, len(phi)) + 1):
        u = u - np.nan_to_num(columns[f"lag_{k}"].astype(float)) * phi[k - 1]
    u[columns[IDX] < max(len(phi), len(theta))] = 0.0
    return u


FAN = 256
LEVELS = 2
_MAP = [T.StructField("move", T.ArrayType(T.DoubleType())), T.StructField("shift", T.ArrayType(T.DoubleType()))]


def _chunk_map(keys, lags):
    """What a chunk does to the filter state (newest value first): ``state -> move @ state + shift``."""
    def maps(groups):
        out = []
        for key, header, columns in groups:
            if header is None or columns is None:
                continue
            phi, theta = [np.asarray(header[n], dtype=float) for n in ("phi", "theta")]
            q = len(theta)
            e = np.concatenate([np.zeros(q), kernels.ma_filter(_inputs(columns, phi, theta, lags), theta)])
            step = np.eye(q, k=-1)
            step[:1] = -theta
            move = np.linalg.matrix_power(step, len(columns[IDX])) if q else step
            out.append([*key, move.ravel().tolist(), e[::-1][:q].tolist()])
        return pd.DataFrame(out, columns=[*keys, "move", "shift"])
    return maps


def _maps(pdf: pd.DataFrame):
    for move, shift in zip(pdf["move"], pdf["shift"]):
        shift = np.asarray(shift, dtype=float)
        yield np.asarray(move, dtype=float).reshape(len(shift), len(shift)), shift


def _composed(by):
    def run(pdf):
        pdf = pdf.sort_values(CHUNK)
        move, shift = None, None
        for m, s in _maps(pdf):
            move, shift = (m, s) if move is None else (m @ move, m @ shift + s)
        head = pdf.iloc[0]
        return pd.DataFrame([[*[head[k] for k in by], head[CHUNK] // FAN, move.ravel().tolist(), shift.tolist()]], columns=[*by, CHUNK, "move", "shift"])
    return run


def _handed_down(by):
    """Start states of neighbours from that of their block (``start``, null: zeros)."""
    def run(pdf):
        pdf = pdf.sort_values(CHUNK)
        first = pdf["start"].iloc[0]
        state, starts = None if first is None else np.asarray(first, dtype=float), []
        for move, shift in _maps(pdf):
            state = np.zeros(len(shift)) if state is None else state
            starts.append(state.tolist())
            state = move @ state + shift
        return pdf[[*by, CHUNK]].assign(start=starts)
    return run


def scan_states(maps: DataFrame, by) -> DataFrame:
    """``by, chunk, start``: prefix scan over ``maps(by, chunk, move, shift)``; the first chunk of a series starts from zeros."""
    fields = [maps.schema[k] for k in (*by, CHUNK)]
    state = T.ArrayType(T.DoubleType())
    block = F.expr(f"{CHUNK} div {FAN}")
    levels = [maps]
    for _ in range(LEVELS):
        levels.append(levels[-1].groupBy(*by, block.alias("_block")).applyInPandas(_composed(by), T.StructType([*fields, *_MAP])))
    schema = T.StructType([*fields, T.StructField("start", state)])
    top = levels[-1].withColumn("start", F.lit(None).cast(state))
    starts = top.groupBy(*by).applyInPandas(_handed_down(by), schema)
    for lower in reversed(levels[:-1]):
        held = lower.withColumn("_block", block).join(starts.withColumnRenamed(CHUNK, "_block"), [*by, "_block"])
        starts = held.groupBy(*by, "_block").applyInPandas(_handed_down(by), schema)
    return starts


def _filtered(keys, lags):
    def pieces(groups):
        groups = [g for g in groups if g[1] is not None and g[2] is not None]
        if not groups:
            return pd.DataFrame(columns=[*keys, IDX, VALUE, "residual"])
        found = []
        for _, header, columns in groups:
            phi, theta, start = [np.asarray(header[n], dtype=float) for n in ("phi", "theta", "start")]
            found.append(kernels.ma_filter(_inputs(columns, phi, theta, lags), theta, start if len(start) else None))
        sizes = [len(e) for e in found]
        named = {k: pd.Series([key[i] for key, _, _ in groups]).repeat(sizes).to_numpy() for i, k in enumerate(keys)}
        return pd.DataFrame({**named, **{c: np.concatenate([columns[c] for _, _, columns in groups]) for c in (IDX, VALUE)},
                             "residual": np.concatenate(found)})

    return pieces


def start_states(rows: DataFrame, params: DataFrame, lags: int, by) -> DataFrame:
    """Filter state each chunk has to start from: ``params`` per chunk plus ``start``.

    A series of one chunk (``_end`` is 0) starts from zeros and takes no part in the scan, so the scan's work goes with the
    number of full chunks, not with that of series.
    """
    keys = [*by, CHUNK]
    schema = T.StructType([*[rows.schema[k] for k in keys], *_MAP])
    # written once: the scan reads the maps on its way up and on its way down
    maps = layout.durable(layout.map_groups(rows.filter("_end > 0").drop("_end", VALUE), params.filter("_end > 0").select(*keys, "phi", "theta"),
                                            keys, _chunk_map(keys, lags), schema))
    return params.join(scan_states(maps, by), keys, "left").withColumn("start", F.coalesce("start", F.array().cast("array<double>")))


def arma_residuals(df: DataFrame, fits: DataFrame, max_p: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    """``(by, idx, y, residual, fitted)`` for one fit row per group (``phi, theta, mean``).

    The series has to be on the scale of the fit (already differenced); ``max_p`` bounds the AR orders.
    """
    s = layout.with_index(df, by, bounded=bounded)
    keys, end = layout.keys(s, by), []
    good = fits.filter(F.col("phi").isNotNull()).select(*by, "phi", "theta", "mean")
    if layout.has_chunks(s):
        last = s.groupBy(*by).agg(F.expr(f"max({IDX}) div {layout.chunk_rows(s)}").alias("_end"))
        params = good.join(last, [*by]).withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("long"), "_end")))
        end = ["_end"]
        s = s.join(params.select(*keys, "mean", *end), keys)
    else:
        params = good.withColumn("start", F.array().cast("array<double>"))
        s = s.join(good.select(*by, "mean"), [*by])
    rows = layout.with_lags(s.withColumn("_w", F.col(VALUE) - F.col("mean")).drop("mean"), "_w", max_p, by)
    rows = rows.select(*keys, IDX, VALUE, "_w", *end, *[f"lag_{k}" for k in range(1, max_p + 1)])
    if layout.has_chunks(s):
        params = start_states(rows, params, max_p, by)
    schema = T.StructType([rows.schema[c] for c in (*keys, IDX, VALUE)] + [T.StructField("residual", T.DoubleType())])
    out = layout.map_groups(rows.drop(*end), params.select(*keys, "phi", "theta", "start"), keys, _filtered(keys, max_p), schema)
    return out.withColumn("fitted", F.col(VALUE) - F.col("residual"))


def fitted_values(df: DataFrame, fits: DataFrame, max_p: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    return arma_residuals(df, fits, max_p, by, bounded).select(*by, IDX, "fitted")


def css_loglik(residual_rows: DataFrame, by=BY) -> DataFrame:
    """Conditional Gaussian log-likelihood with the variance at its maximum."""
    g = residual_rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("rss"))
    s2 = F.col("rss") / F.col("n")
    return g.select(*by, "n", "rss", s2.alias("sigma2"),
                    criteria.loglik(F.col("n"), F.col("rss"), F.when(s2 > 0, s2)).alias("log_likelihood"))


def model_residuals(df: DataFrame, fits: DataFrame, d: int = 0, max_p: int = 5, by=BY,
                    bounded: bool = False) -> DataFrame:
    """Residuals and fitted values of fitted models; differenced first when the models are."""
    s = shaping.difference(layout.with_index(df, by, bounded=bounded), d, by)
    return arma_residuals(s, fits, max_p, by)


def with_tails(df: DataFrame, fits: DataFrame, depth: int = 5, d: int = 0, by=BY, bounded: bool = False) -> DataFrame:
    """Stored parameters plus what forecasting starts from: latest values, residuals, levels."""
    whole = layout.with_index(df, by, bounded=bounded)
    rows = model_residuals(whole, fits, d, depth, by)
    n = rows.groupBy(*by).agg(F.max(IDX).alias("_end"))
    tail = layout.join_series(rows, n, by).filter(F.col(IDX) > F.col("_end") - depth)
    newest = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(IDX), F.col(VALUE).alias("v"), F.col("residual").alias("e")))))
    tail = tail.groupBy(*by).agg(newest.alias("_t"))
    keep = [c for c in fits.columns if c not in ("y_tail", "e_tail", "levels")]
    out = fits.select(*keep).join(tail, [*by]).withColumns({
        "y_tail": F.transform("_t", lambda r: r["v"] - F.col("mean")),
        "e_tail": F.col("_t.e")}).drop("_t")
    if d:
        return out.join(shaping.last_levels(whole, d, by), [*by])
    return out.withColumn("levels", F.array().cast("array<double>"))
