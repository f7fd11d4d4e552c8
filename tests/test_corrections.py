"""Answers that do not depend on settings or sizes, and groups that are never lost."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.operators import diagnostics, estimation, forecasting, linalg, shaping, stationarity
from tidemark.plans import workflow
from tidemark.sources import files, ingest


def table(spark, **series):
    rows = [(k, i, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, t long, y double")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    good = np.zeros(160)
    for t in range(1, 160):
        good[t] = 0.6 * good[t - 1] + rng.normal()
    return table(spark, good=good + 20, flat=[3.0] * 160, short=rng.normal(size=12), empty=[None] * 40)


def test_kpss_does_not_depend_on_a_setting(spark):
    df = table(spark, x=np.cumsum(np.random.default_rng(1).normal(size=300)))
    one = stationarity.kpss_test(df).first()
    s = layout.with_index(df)
    spark.conf.set(layout.WHOLE_ROWS_CONF, "30")
    try:
        assert stationarity.kpss_test(s).first() == one
    finally:
        spark.conf.unset(layout.WHOLE_ROWS_CONF)


def test_shapiro_above_five_thousand_rows(spark):
    x = np.random.default_rng(2).normal(size=5001)
    df = pd.DataFrame({"series_id": "x", "idx": range(5001), "residual": x})
    r = diagnostics.shapiro_wilk(spark.createDataFrame(df)).first()
    assert 0.999 < r.shapiro_stat <= 1 and 0 < r.shapiro_p <= 1
    skewed = diagnostics.shapiro_wilk(spark.createDataFrame(df.assign(residual=np.exp(x)))).first()
    assert skewed.shapiro_stat < 0.8 and skewed.shapiro_p < 1e-6


def test_the_newest_row_is_in_a_window(spark):
    df = table(spark, a=range(203), b=range(449), c=range(61))
    last = {"a": 202, "b": 448, "c": 60}
    sliding = shaping.sliding_windows(layout.with_index(df)).groupBy("series_id").agg(F.max("end_idx").alias("stop"))
    assert {r.series_id: r.stop - 1 for r in sliding.collect()} == last
    for w in (shaping.assign_sliding(df), shaping.fixed_windows(df)):
        assert {r.series_id: r.m for r in w.groupBy("series_id").agg(F.max("y").alias("m")).collect()} == last
    fixed = shaping.fixed_windows(df).groupBy("series_id").agg(F.count("*").alias("n"))
    assert {r.series_id: r.n - 1 for r in fixed.collect()} == last


def test_columns_that_begin_with_missing_values(spark):
    df = spark.createDataFrame([(None, None)] * 12 + [("$1", "x"), ("$2", "y")], "price string, name string")
    assert ingest.suggest_numeric_columns(df) == ["price"]
    late = spark.createDataFrame([("1",)] * 30 + [("no number",)], "price string")
    assert ingest.suggest_numeric_columns(late) == []


def test_limits_are_errors_not_cuts(spark, tmp_path):
    coo = spark.createDataFrame([(0, 0, 1.0), (0, 7, 2.0)], "row long, col long, value double")
    with pytest.raises(Exception, match="column beyond"):
        ingest.coo_to_rows(coo, 3).collect()
    table(spark, a=[1, 2]).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="order"):
        files.read_parquet_column(spark, str(tmp_path / "p"), "y", rows=1)


def test_samples_do_not_depend_on_partitions(spark):
    df = table(spark, a=range(500))
    one, two = (sorted(r.t for r in ingest.sample_rows(df.repartition(n), 0.3).collect()) for n in (1, 7))
    assert one == two and 100 < len(one) < 200


def test_every_series_has_fit_and_forecast_rows(spark, mixed):
    everyone = {"good", "flat", "short", "empty"}
    for order in ((1, 0, 0), (1, 0, 1), (0, 1, 1)):
        fits = {r.series_id: r for r in estimation.fit_groups(mixed, order).collect()}
        assert set(fits) == everyone and fits["good"].success
        assert not fits["empty"].success and fits["empty"].error and not fits["flat"].success
    rows = forecasting.forecast_groups(mixed, (1, 0, 0), 4).collect()
    assert len(rows) == 16 and {r.series_id for r in rows if r.status != "ok"} == {"flat", "empty"}
    assert {r.series_id for r in estimation.fit_groups(mixed, auto=True).collect()} >= {"good", "short", "empty"}


def test_order_searches_keep_series_without_success(spark, mixed):
    s = layout.with_index(mixed.filter("y is not null"))
    found = {r.series_id: r.p for r in estimation.ar_order_aic(s, 2).collect()}
    assert set(found) == {"good", "flat", "short"} and found["good"] and found["flat"] is None
    assert {r.series_id for r in estimation.arma_order_grid(s, 1, 1).collect()} == set(found)


def test_workflow_keeps_every_series(spark, mixed):
    res = workflow.wf_fit(mixed, "AR", "manual", 2, 0)
    fits = {r.series_id: r for r in res.fits.collect()}
    assert set(fits) == {"good", "flat", "short", "empty"} and fits["good"].success
    assert all(fits[k].error for k in fits if not fits[k].success)
    ahead = workflow.wf_forecast(res, 3).collect()
    assert len(ahead) == 12 and all(r.forecast is not None for r in ahead if r.series_id == "good")


def test_arma_neighbours_stay_arma(spark):
    rng = np.random.default_rng(3)
    df = layout.with_index(table(spark, x=rng.normal(size=200)))
    one = lambda v: F.lit(v).cast("long").alias
    orders = df.select("series_id").distinct().select("series_id", one(1)("p"), one(0)("d"), one(1)("q"))
    failed = df.groupBy("series_id", F.expr("idx div 50").alias("window_id")).agg(F.lit(False).alias("overall_pass"))
    r = workflow.wf_adjust(df, orders, failed, "ARMA").first()
    assert r.p >= 1 and r.q >= 1


def test_methods_that_fail_keep_a_row(spark, mixed):
    rows = workflow.method_accuracy(mixed, {"AR": (1, 0, 0), "huge": (9, 2, 9)}).collect()
    assert {(r.series_id, r.method) for r in rows} == {(k, m) for k in ("good", "flat", "short", "empty") for m in ("AR", "huge")}


def test_hot_values_in_rank_correlation(spark):
    rng = np.random.default_rng(4)
    a = np.where(rng.random(600) < 0.6, 1.0, rng.normal(size=600).round(2))
    b = a + rng.normal(size=600)
    frame = pd.DataFrame({"a": a, "b": b})
    frame.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([(float(x), None if y != y else float(y)) for x, y in zip(frame.a, frame.b)], "a double, b double")
    for method in ("pearson", "spearman"):
        got = {(r.var_a, r.var_b): r.corr for r in linalg.correlation_matrix(df, ["a", "b"], method).collect()}
        ranked = frame if method == "pearson" else frame.rank()
        assert abs(got["a", "b"] - ranked.corr().loc["a", "b"]) < 1e-9


def test_adf_of_many_groups_is_solved_in_stacks(spark, monkeypatch):
    """Finding F18: every group paid a matrix solve for each lag candidate and every row 105 running sums."""
    from tidemark.operators import regression
    rng = np.random.default_rng(6)
    gram = [x.T @ x for x in rng.normal(size=(30, 20, 5))]
    beta, se, rss = regression.solve_many(np.array(gram), np.arange(30, 60))
    for k in range(30):
        for one, many in zip(regression.solve(gram[k], 30 + k), (beta[k], se[k], rss[k])):
            np.testing.assert_allclose(one, many, rtol=1e-9)
    df = table(spark, a=np.cumsum(rng.normal(size=90)), b=rng.normal(size=30), c=[1.0, 2.0, 4.0], d=[3.0] * 40)
    found = {r.series_id: r for r in stationarity.adf_test(df).collect()}
    assert set(found) == set("abcd") and found["c"].adf_stat is None and found["d"].adf_stat is None
    assert found["b"].adf_stationary and not found["a"].adf_stationary


def test_evaluation_reads_written_residuals(spark):
    """Finding F15: every diagnostic filtered the series anew; the query now reads residuals that were written once."""
    from harness import DATA
    from tidemark.plans.queries import REGISTRY
    plan = REGISTRY["evaluate_model"][0](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_choose_d_passes_once_over_the_rows(spark):
    """Finding F19: both tests and each differencing order windowed the series anew, and every later step the raw table."""
    rng = np.random.default_rng(8)
    df = table(spark, noise=rng.normal(size=120), short=np.cumsum(rng.normal(size=90)), walk=np.cumsum(rng.normal(size=200)))
    plan = stationarity.choose_d(layout.with_index(df))._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
    rows, state = workflow.wf_prepare(df, "AR")
    for out in (rows, state):
        leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
        assert all("parquet" in leaves.apply(k).toString() for k in range(leaves.size()))
    assert {r.series_id: r.d for r in state.collect()} == {"noise": 0, "short": 0, "walk": 1}


def test_lag_candidates_share_one_elimination(monkeypatch):
    """Finding F19: every lag candidate cost a matrix inverse of its own."""
    from tidemark.operators import regression
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 60, 15))
    x[:, :, 0] = 1.0
    x[30:, :, 6] = x[30:, :, 5] - x[30:, :, 4]  # singular from the seventh regressor on
    gram, m = np.einsum("gti,gtj->gij", x, x), np.full(40, 73)
    rss, sound = regression.nested_rss(gram)
    assert sound[:30].all() and sound[30:, :6].all() and not sound[30:, 6:].any()
    for k in range(1, 14):
        keep = [*range(k), 14]
        want = regression.solve_many(gram[:, keep][:, :, keep], m)[2]
        np.testing.assert_allclose(rss[:, k - 1][sound[:, k - 1]], want[sound[:, k - 1]], rtol=1e-8)
    known, solved = np.full(40, 14), []
    count = lambda g, n: solved.append(len(g)) or regression.solve_many(g, n)
    monkeypatch.setattr(stationarity, "solve_many", count)
    stat, used = stationarity._adf_stats(gram[:30], x[:30, 0, :14], known[:30], m[:30], "c", 12, True)
    assert sum(solved) == 30
    monkeypatch.setattr(stationarity, "nested_rss", lambda g: (rss[:30], sound[:30] & False))
    alone, asked = stationarity._adf_stats(gram[:30], x[:30, 0, :14], known[:30], m[:30], "c", 12, True)
    assert (used == asked).all() and np.allclose(stat, alone)


def test_stationarity_of_series_cut_by_batches(spark):
    """Lags and cumulated sums go on where a batch of rows ends inside a series."""
    rng = np.random.default_rng(10)
    df = layout.with_index(table(spark, a=rng.normal(size=150), b=np.cumsum(rng.normal(size=70)), c=rng.normal(size=5), d=[2.0] * 30,
                                 e=rng.normal(size=1), lost=[None] * 9))
    ask = lambda: {(r.series_id, name): r for name, t in (("c", stationarity.stationarity(df)), ("ct", stationarity.stationarity(df, "ct", 2)))
                   for r in t.collect()}
    whole = ask()
    assert len(whole) == 12 and whole["lost", "c"].kpss_stat is None
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("1", "7"):
            spark.conf.set(name, size)
            for key, row in ask().items():
                for a, b in zip(row, whole[key]):
                    assert a == b or abs(a - b) < 1e-8 * max(1.0, abs(b)), (size, key, row, whole[key])
    finally:
        spark.conf.set(name, before)
