"""Hand-checked values, edge cases, recovery of simulated models."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.operators import (accuracy, cleaning, correlation, diagnostics, estimation, forecasting, kernels, linalg,
                                quality, shaping, stationarity, transforms)
from tidemark.plans import workflow
from tidemark.sources import ingest


def series(spark, **values):
    rows = [(k, i, None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"{SERIES} string, {TIME} long, {VALUE} double")


def by_series(df, column):
    return {r[SERIES]: r[column] for r in df.collect()}


EDGE = dict(constant=[5.0] * 12, one=[3.0], two=[1.0, 2.0], gone=[None] * 4, holes=[None, 1.0, None, 3.0, None, None])


def test_fills(spark):
    filled = cleaning.fill_linear(series(spark, **EDGE))
    rows = sorted((r[IDX], r[VALUE]) for r in filled.filter(F.col(SERIES) == "holes").collect())
    assert [v for _, v in rows] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert filled.filter((F.col(SERIES) == "gone") & F.col(VALUE).isNotNull()).count() == 0


def test_edge_series_never_fail(spark):
    s = series(spark, **EDGE)
    assert quality.validate_series(s).count() == 5
    stats = by_series(quality.basic_stats(s), "mean")
    assert stats["gone"] == 0.0 and stats["constant"] == 5.0
    present = layout.with_index(cleaning.drop_missing(s))
    assert by_series(correlation.acf(present), "acf")["constant"] == [1.0] * 4
    assert not by_series(stationarity.adf_test(present), "adf_stationary")["constant"]
    assert set(by_series(stationarity.kpss_test(present), "kpss_stat")) == {"constant", "one", "two", "holes"}
    fits = estimation.fit_orders(present, [(1, 0, 1)])
    assert set(by_series(fits, "success").values()) == {False}
    assert set(by_series(estimation.ar_fit(present, [1]), "success").values()) == {False}
    out = forecasting.forecast_groups(present, (1, 0, 1), 3)
    assert out.count() == 12 and out.filter("status = 'ok'").count() == 0
    scaled = transforms.standard_scale(present)
    assert by_series(scaled, "error")["constant"] is not None
    assert transforms.boxcox_transform(series(spark, a=[-1, 2, 3])).filter("error is null").count() == 0


def test_nonfinite(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("inf")), ("a", 2, float("nan")), ("a", 3, 3.0)],
                              f"{SERIES} string, {TIME} long, {VALUE} double")
    s = ingest.as_series(s, SERIES, TIME, VALUE)
    assert by_series(quality.check_infinite(s), "has_infinite")["a"]
    assert by_series(quality.missing_report(s), "missing_count")["a"] == 1
    assert sorted(r[VALUE] for r in cleaning.fill_nonfinite_median(s).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_resample_origin(spark):
    hours = pd.DataFrame({"t": pd.date_range("2024-03-01", periods=48, freq="h"), "y": np.arange(48.0)})
    days = pd.DataFrame({"t": pd.date_range("2024-03-01", periods=10, freq="D"), "y": 1.0})
    make = lambda p: spark.createDataFrame(p).select(F.lit("a").alias(SERIES), F.col("t").cast("timestamp_ntz").alias(TIME), F.col("y").alias(VALUE))
    assert sorted(r[VALUE] for r in shaping.resample(make(hours), 86400).collect()) == [11.5, 35.5]
    assert [r[VALUE] for r in shaping.resample(make(days), 5 * 86400, "sum").collect()] == [5.0, 5.0]


def test_column_suggestions(spark):
    d = spark.createDataFrame([(1, "$1"), (2, "$2")], "fecha int, b string")
    assert ingest.suggest_datetime_column(d) == "fecha"
    assert ingest.suggest_numeric_columns(d) == ["fecha", "b"]
    assert ingest.suggest_numeric_columns(spark.createDataFrame([("2024-01-01",)], "Mes string")) == []
    money = spark.createDataFrame([("$1,228,301,354.06",), ("12%",), ("x",)], "m string")
    assert [r[0] for r in money.select(ingest.parse_numeric(F.col("m"))).collect()] == [1228301354.06, 12.0, None]


def test_series_from_values(spark):
    s = ingest.series_from_values(spark, np.array([1.0, np.nan, 3.0]))
    assert [r[VALUE] for r in s.orderBy(IDX).collect()] == [1.0, None, 3.0]
    with pytest.raises(ValueError):
        ingest.series_from_values(spark, np.zeros((2, 2)))


def _simulate(n, phi=(), theta=(), seed=0, mean=0.0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        y[t] = e[t] + sum(p * y[t - i] for i, p in enumerate(phi, 1) if t >= i) + sum(q * e[t - i] for i, q in enumerate(theta, 1) if t >= i)
    return y + mean


def test_recovery(spark):
    s = series(spark, ar1=_simulate(300, [0.7]), ar2=_simulate(400, [0.6, -0.3], seed=1), ma1=_simulate(300, (), [0.5], 2),
               arma=_simulate(400, [0.6], [0.4], 3))
    assert abs(by_series(estimation.ar_fit(s, [1]), "phi")["ar1"][0] - 0.7) < 0.15
    assert np.allclose(by_series(estimation.ar_fit(s, [2]), "phi")["ar2"], [0.6, -0.3], atol=0.2)
    assert abs(by_series(estimation.ma_fit(s, 1), "theta")["ma1"][0] - 0.5) < 0.15
    fit = [r for r in estimation.arma_fit(s, 1, 1).collect() if r[SERIES] == "arma"][0]
    assert abs(fit.phi[0] - 0.6) < 0.25 and abs(fit.theta[0] - 0.4) < 0.25


def test_kernel_beats_a_grid():
    w = _simulate(200, [0.5], [0.4], 7)
    w = w - w.mean()
    rss = kernels.css_fit(w, 1, 1)[2]
    grid = min(float(np.sum(kernels.residuals(w, np.array([a]), np.array([b])) ** 2))
               for a in np.linspace(-0.95, 0.95, 39) for b in np.linspace(-0.95, 0.95, 39))
    assert rss <= grid + 1e-9


def test_filter_and_residuals_by_hand():
    w, phi, theta = _simulate(150, [0.3], [0.2], 5), np.array([0.4, 0.1]), np.array([0.3, -0.5])
    e = np.zeros(150)
    for t in range(2, 150):
        e[t] = w[t] - phi @ w[t - 2:t][::-1] - theta @ e[t - 2:t][::-1]
    np.testing.assert_allclose(kernels.residuals(w, phi, theta), e, atol=1e-12)


def test_adf_lags_by_hand(spark):
    """The one-pass gram gives the t-statistic of the plain regression."""
    y = _simulate(120, [0.8], seed=11, mean=50)
    got = stationarity.adf_test(series(spark, a=y), max_lags=3).first()
    dy = np.diff(y)
    rows = range(4, 120)
    x = np.array([[1.0, y[t - 1], dy[t - 2], dy[t - 3], dy[t - 4]] for t in rows])
    target = np.array([dy[t - 1] for t in rows])
    beta, rss, *_ = np.linalg.lstsq(x, target, rcond=None)
    se = math.sqrt(rss[0] / (len(target) - 5) * np.linalg.inv(x.T @ x)[1, 1])
    assert got.adf_lags == 3 and abs(got.adf_stat - beta[1] / se) < 1e-6


def test_choose_d(spark):
    rng = np.random.default_rng(4)
    s = series(spark, noise=rng.normal(size=300), walk=np.cumsum(rng.normal(size=300)))
    assert by_series(stationarity.choose_d(s), "d") == {"noise": 0, "walk": 1}


def test_forecast_paths_agree(spark):
    """The array fold, the block kernel and a plain loop forecast the same ARIMA(2, 2, 2)."""
    y = np.cumsum(np.cumsum(_simulate(120, [0.5], [0.3], 9)))
    fits = layout.durable(estimation.fit_orders(series(spark, a=y), [(2, 2, 2)]))
    fold = [r.forecast for r in forecasting.forecast_rows(fits, 30).orderBy("step").collect()]
    blocks = [r.forecast for r in forecasting.forecast_long(fits.withColumn("h", F.lit(30)), "h").orderBy("step").collect()]
    f = fits.first()
    z = np.diff(y, 2) - f.mean
    e = kernels.residuals(z, np.array(f.phi), np.array(f.theta))
    zs, es = list(z), list(e)
    for _ in range(30):
        zs.append(f.phi[0] * zs[-1] + f.phi[1] * zs[-2] + f.theta[0] * es[-1] + f.theta[1] * es[-2])
        es.append(0.0)
    slope, level, want = y[-1] - y[-2], y[-1], []
    for v in zs[-30:]:
        slope += v + f.mean
        level += slope
        want.append(level)
    np.testing.assert_allclose(fold, want, rtol=1e-9)
    np.testing.assert_allclose(blocks, want, rtol=1e-9)


def test_interval_contains_forecast(spark):
    out = forecasting.arima_forecast(series(spark, a=_simulate(100, [0.5], seed=2)), 1, 1, 1, 12).collect()
    assert len(out) == 12 and all(r.lower < r.forecast < r.upper for r in out)
    widths = [r.upper - r.lower for r in sorted(out, key=lambda r: r.step)]
    assert widths == sorted(widths)


def test_shapiro_and_ks(spark):
    # published example: weights of eleven men, W = 0.79
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    s = series(spark, men=men).withColumnsRenamed({VALUE: "residual", TIME: IDX})
    r = diagnostics.shapiro_wilk(s).first()
    assert abs(r.shapiro_stat - 0.79) < 0.005 and abs(r.shapiro_p - 0.0067) < 0.002
    k = diagnostics.ks_normal(s).first()
    x = np.sort(np.array(men, dtype=float))
    cdf = [0.5 * (1 + math.erf((v - x.mean()) / x.std() / math.sqrt(2))) for v in x]
    want = max(max((i + 1) / 11 - c, c - i / 11) for i, c in enumerate(cdf))
    assert abs(k.ks_stat - want) < 1e-9


def test_metrics_edges(spark):
    d = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.0, 1.0)], f"{SERIES} string, step long, actual double, predicted double")
    r = accuracy.evaluate_forecast(d).first()
    assert r.mape == math.inf and r.mase == math.inf and r.smape == 200.0


def test_matrix_ops(spark):
    a, b = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    coo = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])],
                                          "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in linalg.matmul(coo(a), coo(b)).collect()}
    assert got == {(i, j): (a @ b)[i, j] for i in range(2) for j in range(4)}
    c = linalg.correlation_matrix(spark.createDataFrame([(1.0, 7.0), (2.0, 7.0)], "a double, b double"), ["a", "b"])
    assert {(r.var_a, r.var_b): r.corr for r in c.collect()}[("a", "b")] is None


def test_workflow_modes(spark):
    s = layout.with_index(series(spark, a=_simulate(220, [0.75], seed=6)))
    with pytest.raises(ValueError):
        workflow.wf_grid_mode(s, None, "manual", 2)
    res = workflow.wf_fit(s, "AR", "manual", 2, 1)
    f = res.fits.first()
    assert f.success and f.p in (1, 2, 3) and f.q == 0
    out = workflow.wf_forecast(res, 5).collect()
    assert len(out) == 5 and all(r.lower <= r.forecast <= r.upper for r in out)
    assert "AR workflow" in workflow.wf_results(res).first().summary


def test_equal_times_are_not_sorted_by_value(spark):
    s = spark.createDataFrame([("a", 0, float(v)) for v in range(200)], f"{SERIES} string, {TIME} long, {VALUE} double")
    values = [r[VALUE] for r in layout.with_index(s).orderBy(IDX).collect()]
    assert sorted(values) == [float(v) for v in range(200)]
    assert abs(np.corrcoef(values[1:], values[:-1])[0, 1]) < 0.3


def test_spearman_ranks_over_partition_edges(spark):
    """Runs of ties longer than a partition, missing values and NaN: ranks as pandas gives them."""
    import numpy as np
    import pandas as pd

    from tidemark.operators import linalg
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"a": np.concatenate([np.full(3000, 7.0), rng.integers(0, 40, 1500).astype(float), rng.normal(size=500)]),
                          "b": np.concatenate([rng.integers(0, 3, 4000), np.arange(1000)]).astype(float)})
    rows = [(None if k % 17 == 0 else float(x), float(y)) for k, (x, y) in enumerate(zip(table.a, table.b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    numbered = layout.durable(df.withColumn("_row", F.monotonically_increasing_id()))
    got = {r._row: r.rank_a for r in linalg.average_ranks(numbered, "a", "_row").collect()}
    kept = [r for r in numbered.collect() if r.a is not None]
    want = pd.Series([r.a for r in kept]).rank()
    assert got == {r._row: w for r, w in zip(kept, want)}
    corr = {(r.var_a, r.var_b): r["corr"] for r in linalg.correlation_matrix(df, ["a", "b"], "spearman").collect()}
    full = pd.DataFrame(rows, columns=["a", "b"])
    ra, rb = full.a.rank(), full.b.rank()
    assert abs(corr["a", "b"] - ra.corr(rb)) < 1e-9


@pytest.mark.parametrize("tile, slab", [(256, 64), (4, 2)])
def test_tiled_product(spark, monkeypatch, tile, slab):
    from tidemark.operators import linalg
    monkeypatch.setattr(linalg, "TILE", tile)
    monkeypatch.setattr(linalg, "SLAB", slab)
    a = [(i, k, float(i * 3 - k)) for i in range(-3, 9) for k in range(0, 30, 2)] + [(100, 4, None), (101, 1, 5.0), (0, 2, 1.5), (102, 6, 0.0)]
    b = [(k, j, float(k + j)) for k in range(0, 30, 3) for j in (-7, 0, 5)] + [(4, 0, 2.0), (1, 3, None)]
    left, right = (spark.createDataFrame(x, "row long, col long, value double") for x in (a, b))
    want = {}
    for i, k, x in a:
        for kk, j, y in b:
            if k == kk:
                want.setdefault((i, j), []).append(None if x is None or y is None else x * y)
    got = {(r.row, r.col): r.value for r in linalg.matmul(left, right).collect()}
    assert set(got) == set(want)
    for at, parts in want.items():
        known = [p for p in parts if p is not None]
        assert got[at] == pytest.approx(sum(known)) if known else got[at] is None, at


def test_prefix_scan_of_chunk_states(spark, monkeypatch):
    """Start states through blocks of two maps, over three levels, equal the plain recursion."""
    import numpy as np

    from tidemark.operators import recursion
    monkeypatch.setattr(recursion, "FAN", 2)
    rng = np.random.default_rng(3)
    maps = {k: (rng.normal(size=(2, 2)) / 2, rng.normal(size=2)) for k in range(13)}
    rows = [("a", k, m.ravel().tolist(), s.tolist()) for k, (m, s) in maps.items()] + [("b", 0, [], [])]
    found = recursion.scan_states(spark.createDataFrame(rows, "series_id string, chunk long, move array<double>, shift array<double>"), ("series_id",))
    got, state = {(r.series_id, r.chunk): r.start for r in found.collect()}, np.zeros(2)
    for k, (m, s) in maps.items():
        np.testing.assert_allclose(got["a", k], state)
        state = m @ state + s
    assert got["b", 0] == [] and len(got) == 14


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))
    local = dict(spark_master="local[2]", spark_sql_warehouse_dir="file:/tmp/w")
    assert layout.scratch_path(session(**local), "x").startswith("file:/tmp/w/tidemark-x-")
    with pytest.raises(ValueError, match="checkpoint"):
        layout.scratch_path(session(**{**local, "spark_master": "spark://a:7077"}), "x")
    assert layout.scratch_path(session(**local, spark_checkpoint_dir="hdfs://a/b/"), "x").startswith("hdfs://a/b/tidemark-x-")
    assert layout.scratch_path(session(spark_master="yarn", spark_sql_warehouse_dir="s3a://w/h"), "x").startswith("s3a://w/h/tidemark-x-")
