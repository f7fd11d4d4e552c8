"""Every ordered operator gives the same result whether a series is one group or many chunks."""

import math

import pytest
from harness import DATA, rows_of
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.operators import (accuracy, cleaning, correlation, diagnostics, estimation, forecasting, linalg, quality,
                                recursion, reports, shaping, stationarity, transforms)
from tidemark.plans.series import Tables
from tidemark.sources import ingest


def source(spark):
    """A third of the users as one long series, the rest short; every eleventh value missing."""
    e = Tables(spark, f"{DATA}/sf0.001")("events")
    series = F.when(F.col("user_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    return e.select(series.alias(SERIES), F.col("ts").alias(TIME),
                    F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value")).alias(VALUE))


def full(spark):
    return source(spark).filter(F.col(VALUE).isNotNull())


def fitted(s):
    return estimation.ar_fit(s, [2])


def resid(s):
    return recursion.ar_residuals(s, fitted(s), 2)


def params(s):
    return s.groupBy(SERIES).agg(F.avg(VALUE).alias("mean")).select(
        SERIES, "mean", F.array(F.lit(0.4), F.lit(0.1)).alias("phi"), F.array(F.lit(0.3), F.lit(-0.5)).alias("theta"))


CASES = {
    "index": (full, lambda s: s),
    "fill_linear": (source, cleaning.fill_linear),
    "fill_forward": (source, cleaning.fill_forward),
    "fill_backward": (source, cleaning.fill_backward),
    "fill_median": (source, cleaning.fill_nonfinite_median),
    "split": (full, cleaning.train_test_split),
    "stats": (source, quality.basic_stats),
    "missing_positions": (source, quality.missing_positions),
    "iqr": (source, quality.outliers_iqr),
    "zscore": (source, lambda s: quality.outliers_zscore(s, 2.0)),
    "mad": (source, quality.outliers_modified_zscore),
    "seasonality": (source, quality.detect_seasonality),
    "trend": (source, quality.detect_trend),
    "validate": (source, quality.validate_series),
    "explore": (full, quality.explore_series),
    "rolling": (full, lambda s: shaping.rolling_std(s, 20)),
    "lags": (full, lambda s: shaping.lag_features(s, 18)),
    "difference": (full, lambda s: shaping.difference(s, 2)),
    "ladder": (full, lambda s: shaping.difference_ladder(s, 2)),
    "levels": (full, lambda s: shaping.last_levels(s, 2)),
    "undifference": (full, lambda s: transforms.inverse_diff(*transforms.diff_transform(s, 2), 2)),
    "variance_ratio": (full, shaping.half_variance_ratio),
    "sliding": (full, lambda s: shaping.assign_sliding(s, 4, 0.3)),
    "fixed": (full, lambda s: shaping.fixed_windows(s, 1, 1, 3)),
    "decompose": (full, lambda s: shaping.seasonal_decompose(s, 12)),
    "ccf": (full, lambda s: linalg.cross_correlation(s.withColumn("z", F.pmod(F.col(VALUE), F.lit(7.0))), VALUE, "z", 4)),
    "seasonal_join": (full, lambda s: linalg.seasonal_join(s, 5)),
    "acf": (full, correlation.acf),
    "pacf": (full, correlation.pacf),
    "bounds": (full, correlation.order_bounds),
    "adf": (full, stationarity.adf_test),
    "adf_trend": (full, lambda s: stationarity.adf_test(s, "ct", 3)),
    "kpss": (full, stationarity.kpss_test),
    "kpss_trend": (full, lambda s: stationarity.kpss_test(s, "ct")),
    "choose_d": (full, stationarity.choose_d),
    "log": (full, transforms.log_transform),
    "boxcox": (full, transforms.boxcox_transform),
    "standard": (full, transforms.standard_scale),
    "minmax": (full, transforms.minmax_scale),
    "ar_fit": (full, lambda s: estimation.ar_fit(s, [0, 1, 2, 3], 1)),
    "ar_forecast": (full, lambda s: forecasting.ar_forecast(s, 2, 6)),
    "ar_residuals": (full, resid),
    "arma_residuals": (full, lambda s: recursion.arma_residuals(s, params(s), 2)),
    "param_search": (full, lambda s: estimation.param_search(s, [-0.5, 0.0, 0.5])),
    "from_params": (full, lambda s: forecasting.predict_from_params(
        s, params(s).withColumn("sigma2", F.lit(2.0)), 5, depth=3)),
    "lag_corr": (full, lambda s: diagnostics.lag_correlation(resid(s))),
    "ks": (full, lambda s: diagnostics.ks_normal(resid(s))),
    "ljung": (full, lambda s: diagnostics.ljung_box(resid(s))),
    "histogram": (full, lambda s: reports.residual_histogram(resid(s))),
    "qq": (full, lambda s: reports.qq_points(resid(s))),
    "residual_acf": (full, lambda s: reports.residual_acf_table(resid(s))),
    "evaluate": (full, lambda s: accuracy.evaluate_forecast(
        resid(s).withColumnRenamed(VALUE, "actual").withColumnRenamed("fitted", "predicted"))),
}


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def table(df):
    df = df.drop(layout.CHUNK)
    cols = sorted(df.columns)
    key = [c for c in (SERIES, "d", "p", "window_id", IDX, "step", "lag", "bin", TIME) if c in cols]
    rows = df.select(*key, *[c for c in cols if c not in key]).collect()
    return sorted((tuple(x) for x in rows), key=lambda t: repr(t[:len(key)])), rows_of


@pytest.mark.parametrize("name", list(CASES))
def test_same_result(spark, name):
    make, op = CASES[name]
    whole, _ = table(op(layout.with_index(make(spark))))
    spark.conf.set(layout.CHUNK_ROWS_CONF, "16")
    spark.conf.set(layout.WHOLE_ROWS_CONF, "30")
    try:
        s = layout.with_index(make(spark))
        assert layout.has_chunks(s)
        parts, _ = table(op(s))
    finally:
        spark.conf.unset(layout.CHUNK_ROWS_CONF)
        spark.conf.unset(layout.WHOLE_ROWS_CONF)
    assert len(whole) == len(parts) and whole
    bad = [(a, b) for a, b in zip(whole, parts) if not close(a, b)]
    assert not bad, (len(bad), bad[:2])


def test_ordered_vector_chunks(split):
    v = ingest.to_ordered_vector(full(split))
    n = v.agg(F.sum(F.size("values")), F.max(F.size("values"))).first()
    assert n[0] == full(split).count() and n[1] <= 16


def test_series_of_one_chunk_are_not_scanned(split, monkeypatch):
    """Finding F1: a table of many short series paid a group call for each of them on every level of the scan."""
    rows = [(f"s{i}", t, float((t * (i + 3)) % 7)) for i in range(20) for t in range(40 if i == 0 else 15)]
    s = layout.add_chunk(layout.with_index(split.createDataFrame(rows, "series_id string, t long, y double")))
    seen, scan = [], recursion.scan_states
    monkeypatch.setattr(recursion, "scan_states", lambda maps, by: seen.append(sorted({r[0] for r in maps.select(SERIES).collect()})) or scan(maps, by))
    parts = recursion.arma_residuals(s, params(s), 2)
    whole = recursion.arma_residuals(s.drop("chunk"), params(s.drop("chunk")), 2)
    found = [{(r[SERIES], r[IDX]): r["residual"] for r in d.collect()} for d in (parts, whole)]
    assert seen == [["s0"]]
    assert found[0].keys() == found[1].keys() and len(found[0]) == len(rows)
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-9
