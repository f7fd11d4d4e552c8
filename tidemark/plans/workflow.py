"""The eleven-step order selection, for every series of a table at once.

AR, MA and ARMA work on the differenced series and integrate the forecast; ARIMA keeps d in its orders.
Each step returns a table.  ``wf_fit`` writes the few tables later steps read again to the shared
checkpoint folder, so no step recomputes an earlier one and a lost executor costs one step at most.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators import (correlation, diagnostics, estimation, forecasting, recursion, selection, shaping,
                                stationarity)
from tidemark.operators.cleaning import drop_missing, train_test_split

FAMILIES = ("AR", "MA", "ARMA", "ARIMA")
MODES = ("auto_n", "acf_pacf", "manual")
SIGNIFICANCE, IMPROVEMENT_PCT = 0.05, 10.0
NO_ORDER = "no order could be fitted on any window"
WINDOW = "window_id"


class Results(NamedTuple):
    state: DataFrame        # step 1: variance ratio, log constant, d
    grid: DataFrame         # steps 2-3: max_p, max_q
    sliding_fits: DataFrame  # steps 4-5
    scores: DataFrame       # step 6
    selected: DataFrame     # step 6: winner and confidence
    reconciled: DataFrame   # step 6b
    backtest: DataFrame     # steps 7-8
    diagnosis: DataFrame    # step 9
    final: DataFrame        # step 10: final order
    fits: DataFrame         # final fit on the whole series
    family: str


def _check(family: str) -> None:
    if family not in FAMILIES:
        raise ValueError("family is AR, MA, ARMA or ARIMA")


def wf_prepare(df: DataFrame, family: str = "ARIMA", d_max: int = 2, by=BY, bounded: bool = False):
    """Step 1: log where the variance grows, then d.  Returns ``(rows, state)``.

    ``rows`` are on the scale the family is fitted on; ``levels`` in ``state`` undo the differencing.
    """
    _check(family)
    s = layout.with_index(drop_missing(df), by, bounded=bounded)
    s = shaping.with_variance_ratio(s, by, _lo=F.min(VALUE))
    s = s.withColumn("log_c", F.when(F.col("needs_log"), F.when(F.col("_lo") <= 0, -F.col("_lo") + 1e-6).otherwise(0.0)))
    s = s.withColumn(VALUE, F.when(F.col("log_c").isNull(), F.col(VALUE)).otherwise(F.ln(F.col(VALUE) + F.col("log_c"))))
    # every later step reads these rows again; the facts of a series stand in its first row
    facts = ("variance_ratio", "needs_log", "n", "log_c")
    s = layout.durable(s.select(*layout.keys(s, by), IDX, VALUE, *[F.when(F.col(IDX) == 0, F.col(c)).alias(c) for c in facts]))
    logged = s.select(*layout.keys(s, by), IDX, VALUE)
    state = s.filter(F.col(IDX) == 0).select(*by, *facts)
    chosen = layout.durable(stationarity.choose_d(logged, d_max, by=by))
    state = state.join(chosen, [*by])
    if family == "ARIMA":
        return logged, state.withColumn("levels", F.array().cast("array<double>"))
    ladder = layout.with_lags(logged, VALUE, max(d_max - 1, 1), by)
    levels = ladder.groupBy(*by).agg(F.max_by(F.array(*[shaping._difference(k) for k in range(d_max)]), IDX).alias("_l"))
    state = state.join(levels, [*by]).withColumn("levels", F.slice("_l", F.lit(1), F.col("d").cast("int"))).drop("_l")
    return at_d(logged, chosen, d_max, by), state


def at_d(rows: DataFrame, chosen: DataFrame, d_max: int = 2, by=BY) -> DataFrame:
    """Each series differenced as often as its own ``d`` says."""
    s, values = shaping.difference_columns(rows, d_max, by)
    s = layout.join_series(s, chosen.select(*by, F.col("d").alias("_want")), by)
    value = F.coalesce(*[F.when(F.col("_want") == d, F.col(v)) for d, v in enumerate(values)])
    out = s.withColumn("_v", value).filter((F.col("_want") <= d_max) & (F.col(IDX) >= F.col("_want")))
    return shaping.rebase(out, F.col("_want")).select(*layout.keys(s, by), IDX, F.col("_v").alias(VALUE))


def wf_grid_mode(rows: DataFrame, state: DataFrame, mode: str = "auto_n", max_p: int | None = None,
                 max_q: int | None = None, family: str = "ARIMA", d_max: int = 2, by=BY) -> DataFrame:
    """Steps 2-3: order ceilings per series, from its length, its correlations, or given."""
    _check(family)
    if mode not in MODES:
        raise ValueError("mode is auto_n, acf_pacf or manual")
    plan = rows.groupBy(*by).agg(F.count("*").alias("n")).withColumns(shaping.window_plan(F.col("n")))
    plan = plan.select(*by, "n", "max_p", "max_q")
    if mode == "auto_n":
        return plan
    if mode == "manual":
        if max_p is None or max_q is None:
            raise ValueError("manual mode needs max_p and max_q")
        return plan.withColumns({"max_p": F.lit(max_p).cast("long"), "max_q": F.lit(max_q).cast("long")})
    steady = at_d(rows, state, d_max, by) if family == "ARIMA" else rows
    found = correlation.order_bounds(steady, by=by).select(*by, F.col("max_p").alias("_p"), F.col("max_q").alias("_q"))
    return plan.join(found, [*by], "left").select(
        *by, "n", F.least("max_p", F.coalesce("_p", F.lit(1))).alias("max_p"),
        F.least("max_q", F.coalesce("_q", F.lit(1))).alias("max_q"))


def wf_orders(grid: DataFrame, state: DataFrame, family: str = "ARIMA", by=BY) -> DataFrame:
    """All orders of the family up to the ceilings."""
    _check(family)
    up = lambda c, lo: F.explode(F.sequence(F.lit(lo).cast("long"), F.greatest(F.col(c), F.lit(lo))))
    g = grid.select(*by, "max_p", "max_q")
    zero = F.lit(0).cast("long")
    if family == "AR":
        return g.select(*by, up("max_p", 1).alias("p")).select(*by, "p", zero.alias("d"), zero.alias("q"))
    if family == "MA":
        return g.select(*by, zero.alias("p"), zero.alias("d"), up("max_q", 1).alias("q"))
    low = 1 if family == "ARMA" else 0
    pairs = g.withColumn("p", up("max_p", low)).withColumn("q", up("max_q", low)).filter(F.col("p") + F.col("q") > 0)
    if family == "ARMA":
        return pairs.select(*by, "p", zero.alias("d"), "q")
    return pairs.join(state.select(*by, "d"), [*by]).select(*by, "p", F.col("d").cast("long").alias("d"), "q")


def wf_sliding_fit(rows: DataFrame, orders: DataFrame, family: str = "ARIMA", num_windows: int | None = None,
                   overlap: float | None = None, by=BY) -> DataFrame:
    """Steps 4-5: every order on every sliding window; failures stay as rows with infinite AICc.

    The AR family needs no gathering: one aggregate per window serves all its orders.
    """
    windowed = shaping.assign_sliding(rows, num_windows, overlap, by)
    keys = (*by, WINDOW)
    if family == "AR":
        top = largest_p(orders)
        fits = estimation.ar_fit(windowed, range(1, top + 1), by=keys, min_obs=estimation.WINDOW_RULE)
        return fits.join(orders.select(*by, "p"), [*by, "p"], "left_semi")
    windows = shaping.sliding_windows(rows, num_windows, overlap, by).select(*keys)
    return estimation.fit_orders(windowed, orders.join(windows, [*by]), keys, estimation.WINDOW_RULE)


def largest_p(orders: DataFrame) -> int:
    """Largest AR order asked for: one small aggregate over the order table."""
    return int(orders.agg(F.max("p")).first()[0] or 1)


def wf_select(fits: DataFrame, by=BY):
    """Step 6: ``(scores per order, winner with confidence)``."""
    scores = selection.score_orders(fits, by)
    return scores, selection.selection_confidence(fits, by)


def wf_reconcile(rows: DataFrame, scores: DataFrame, k: int = selection.TOP_K, by=BY) -> DataFrame:
    """Step 6b: refit the best orders on the whole series, lowest AIC; all failed keeps the winner."""
    top = selection.top_k_orders(scores, k, by)
    best = estimation.best_fit(estimation.fit_orders(rows, top.select(*by, "p", "d", "q"), by), "aic", by).filter("success")
    first = top.filter("position = 1").select(*by, *[F.col(c).alias(f"_{c}") for c in "pdq"])
    return first.join(best.select(*by, "p", "d", "q", "aic"), [*by], "left").select(
        *by, *[F.coalesce(c, f"_{c}").alias(c) for c in "pdq"], "aic", F.col("aic").isNotNull().alias("refitted"))


def _train_windows(rows: DataFrame, orders: DataFrame, num_windows, by) -> DataFrame:
    chosen = layout.join_series(rows, orders.select(*by, "p", "d", "q"), by)
    return shaping.fixed_windows(chosen, F.col("p"), F.col("q"), num_windows, by=by)


def _window_fits(windowed: DataFrame, by) -> DataFrame:
    keys = (*by, WINDOW)
    train = windowed.filter("role = 'train'")
    specs = windowed.groupBy(*keys).agg(*[F.max(c).alias(c) for c in "pdq"])
    sizes = windowed.groupBy(*keys).agg(F.max("train_size").alias("train_size"),
                                        F.count_if(F.col("role") == "test").alias("test_size"))
    return estimation.fit_orders(train.drop("p", "d", "q"), specs, keys).join(sizes, [*keys])


def window_fits(rows: DataFrame, orders: DataFrame, num_windows: int | None = None, by=BY) -> DataFrame:
    """The fit of the training part of each fixed window, written once for the steps that read it."""
    return layout.durable(_window_fits(_train_windows(rows, orders, num_windows, by), by))


def wf_backtest(rows: DataFrame, orders: DataFrame, num_windows: int | None = None, by=BY, fits: DataFrame | None = None) -> DataFrame:
    """Steps 7-8: fit 70 % of each fixed window, forecast the rest, score it; ``fits``: of ``window_fits``, if at hand."""
    keys = (*by, WINDOW)
    windowed = _train_windows(rows, orders, num_windows, by)
    fits = window_fits(rows, orders, num_windows, by) if fits is None else fits
    ahead = forecasting.forecast_long(fits, "test_size", keys)
    truth = windowed.filter("role = 'test'").select(
        *keys, (F.col(IDX) - F.col("train_size") + 1).alias("step"), F.col(VALUE).alias("actual"))
    e = F.col("actual") - F.col("forecast")
    scored = truth.join(ahead, [*keys, "step"]).groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.coalesce(F.avg(F.when(F.col("actual") != 0, F.abs(div(e, F.col("actual"))))) * 100,
                   F.lit(float("inf"))).alias("mape"))
    return fits.join(scored, [*keys], "left").select(
        *keys, "p", "d", "q", "success", "mae", "rmse", "mape", "phi", "theta", "c", "sigma2", "train_size", "test_size", "error")


def backtest_averages(backtest: DataFrame, by=BY) -> DataFrame:
    ok = backtest.filter("success")
    return ok.groupBy(*by).agg(*[F.avg(c).alias(f"avg_{c}") for c in ("mae", "rmse", "mape")],
                               F.count("*").alias("num_success"))


def wf_diagnose(rows: DataFrame, orders: DataFrame, num_windows: int | None = None, d_max: int = 2, by=BY,
                fits: DataFrame | None = None) -> DataFrame:
    """Step 9: residual tests of the training part of each fixed window; ``fits`` as in ``wf_backtest``."""
    keys = (*by, WINDOW)
    windowed = _train_windows(rows, orders, num_windows, by)
    fits = window_fits(rows, orders, num_windows, by) if fits is None else fits
    train = windowed.filter("role = 'train'").select(*layout.keys(windowed, keys), IDX, VALUE)
    steady = at_d(train, fits.select(*keys, "d"), d_max, keys)
    res = recursion.arma_residuals(steady, fits.filter("success"), 5, keys)
    skip = fits.select(*keys, F.greatest("p", "q").alias("_skip"))
    res = layout.durable(res.join(skip, [*keys]).filter(F.col(IDX) >= F.col("_skip")).drop("_skip"))
    c = diagnostics.lag_correlations(res, by=keys)
    stats = diagnostics.residual_stats(res, keys).select(*keys, F.col("mean").alias("residuals_mean"),
                                                         F.col("std").alias("residuals_std"))
    tests = (diagnostics.ljung_box(res, keys, correlations=c)
             .join(diagnostics.residual_acf_pass(res, keys, correlations=c), [*keys]).join(stats, [*keys]))
    out = fits.select(*keys, "p", "d", "q", "success", "error").join(tests, [*keys], "left")
    good = F.coalesce(F.col("lb_p") > SIGNIFICANCE, F.lit(False))
    return out.select(*keys, "p", "d", "q", F.col("lb_stat").alias("ljung_box_statistic"),
                      F.col("lb_p").alias("ljung_box_p_value"), good.alias("ljung_box_pass"),
                      F.col("acf_peaks").alias("acf_significant_peaks"),
                      F.coalesce("acf_pass", F.lit(False)).alias("acf_pass"),
                      (good & F.coalesce("acf_pass", F.lit(False))).alias("overall_pass"),
                      "residuals_mean", "residuals_std", "success", "error")


def wf_adjust(rows: DataFrame, orders: DataFrame, diagnosis: DataFrame, family: str = "ARIMA", by=BY) -> DataFrame:
    """Step 10: neighbours of the order, only for series with two failed windows in a row, only when
    AICc improves by more than a tenth."""
    flagged = shaping.consecutive_failures(diagnosis, by).filter("needs_adjustment").select(*by)
    current = orders.join(flagged, [*by], "left_semi")
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1)])])
    near = (current.withColumn("_s", F.explode(shift))
            .select(*by, (F.col("p") + F.col("_s.a")).alias("p"), "d", (F.col("q") + F.col("_s.b")).alias("q"))
            .filter("p >= 0 and q >= 0 and p + q > 0"))
    if family == "AR":
        near = near.filter("q = 0")
    elif family == "MA":
        near = near.filter("p = 0")
    elif family == "ARMA":
        near = near.filter("p > 0 and q > 0")
    fits = estimation.fit_orders(layout.fresh(rows), near, by).filter("success").select(*by, "p", "d", "q", "aicc")
    base = orders.select(*by, *[F.col(c).alias(f"_{c}") for c in "pdq"])
    both = fits.join(base, [*by]).withColumn("_here", (F.col("p") == F.col("_p")) & (F.col("q") == F.col("_q")))
    level = both.filter("_here").select(*by, F.col("aicc").alias("base_aicc"))
    gain = 100.0 * div(F.col("base_aicc") - F.col("aicc"), F.abs("base_aicc"))
    better = (both.filter("not _here").join(level, [*by]).withColumn("gain", gain)
              .filter(F.col("gain") > IMPROVEMENT_PCT).groupBy(*by)
              .agg(F.min_by(F.struct("p", "q", "gain"), F.struct("aicc", "p", "q")).alias("b")))
    return orders.select(*by, "p", "d", "q").join(better, [*by], "left").select(
        *by, F.coalesce("b.p", "p").alias("p"), "d", F.coalesce("b.q", "q").alias("q"),
        F.col("b").isNotNull().alias("adjusted"), F.coalesce("b.gain", F.lit(0.0)).alias("improvement_pct"))


def wf_fit(df: DataFrame, family: str = "ARIMA", mode: str = "auto_n", max_p: int | None = None,
           max_q: int | None = None, d_max: int = 2, by=BY, bounded: bool = False) -> Results:
    """Steps 1-10 and the final fit on the whole series."""
    rows, state = wf_prepare(df, family, d_max, by, bounded)
    rows, state = layout.durable(rows), layout.durable(state)
    grid = wf_grid_mode(rows, state, mode, max_p, max_q, family, d_max, by)
    orders = wf_orders(grid, state, family, by)
    sliding = layout.durable(wf_sliding_fit(rows, orders, family, by=by))
    scores, selected = wf_select(sliding, by)
    reconciled = layout.durable(wf_reconcile(rows, scores, by=by))
    windows = window_fits(rows, reconciled, by=by)
    backtest = wf_backtest(rows, reconciled, by=by, fits=windows)
    diagnosis = layout.durable(wf_diagnose(rows, reconciled, d_max=d_max, by=by, fits=windows))
    final = layout.durable(wf_adjust(rows, reconciled, diagnosis, family, by))
    done = layout.durable(estimation.fit_orders(layout.fresh(rows), final.select(*by, "p", "d", "q"), by))
    lost = df.select(*by).distinct().join(done.select(*by), [*by], "left_anti")
    fits = layout.durable(done.unionByName(estimation.failed(lost, NO_ORDER, by)))
    return Results(state, grid, sliding, scores, selected, reconciled, backtest, diagnosis, final, fits, family)


def wf_forecast(results: Results, steps: int = 12, alpha: float = 0.05, by=BY) -> DataFrame:
    """Step 11: forecast, undo the differencing, then the log."""
    fits = results.fits
    extra = results.state.select(*by, "log_c", F.col("levels").alias("_levels"))
    fits = fits.join(extra, [*by], "left")
    if results.family != "ARIMA":
        fits = fits.withColumn("levels", F.col("_levels"))
    out = forecasting.forecast_rows(fits, steps, alpha, by).join(results.state.select(*by, "log_c"), [*by], "left")
    undo = lambda c: F.when(F.col("log_c").isNull(), F.col(c)).otherwise(F.exp(c) - F.col("log_c"))
    return out.withColumns({c: undo(c) for c in ("forecast", "lower", "upper")}).drop("log_c")


def wf_results(results: Results, by=BY) -> DataFrame:
    """One text per series: final order, parameters, step summaries."""
    rates = diagnostics.pass_rates(results.diagnosis, by)
    chosen = results.final.withColumns({"_p": F.col("p"), "_d": F.col("d"), "_q": F.col("q")}).drop("p", "d", "q")
    # every fit row has a text, so that a series whose orders all failed is not lost
    t = (results.fits.select(*by, "aic", "sigma2", "success", "error").join(chosen, [*by], "left")
         .join(results.state.select(*by, "n", "needs_log", F.col("d").alias("series_d")), [*by], "left")
         .join(results.selected.select(*by, "confidence"), [*by], "left")
         .join(backtest_averages(results.backtest, by), [*by], "left").join(rates, [*by], "left")
         .withColumns({"p": F.col("_p"), "d": F.col("_d"), "q": F.col("_q")}))
    d = F.col("d") if results.family == "ARIMA" else F.col("series_d")
    num = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("n/a")))
    text = F.concat_ws("\n", F.format_string(f"{results.family} workflow: order (%d, %d, %d)", "p", d, "q"),
                       F.format_string("Observations: %d", F.col("n")),
                       F.concat(F.lit("Log transform: "), F.when(F.col("needs_log"), "yes").otherwise("no")),
                       num("Selection confidence", "confidence"), num("Back-test MAE", "avg_mae"),
                       num("Back-test RMSE", "avg_rmse"), num("Overall pass rate", "overall_pass_rate"),
                       F.concat(F.lit("Adjusted: "), F.when(F.col("adjusted"), "yes").otherwise("no")),
                       num("AIC", "aic"), num("Sigma2", "sigma2"))
    lost = F.concat(F.lit(f"{results.family} workflow: no order; "), F.coalesce("error", F.lit("no fit")))
    return t.select(*by, "p", d.alias("d"), "q", F.when(F.col("p").isNull(), lost).otherwise(text).alias("summary"))


def method_accuracy(df: DataFrame, orders: dict, test_ratio: float = 0.2, by=BY, bounded: bool = False) -> DataFrame:
    """RMSE / MAE / MAPE of several named orders on one chronological hold-out."""
    s = train_test_split(drop_missing(df), test_ratio, by, bounded)
    n = s.groupBy(*by).agg(F.count_if(F.col("role") == "train").alias("_train"),
                           F.count_if(F.col("role") == "test").alias("horizon"))
    train = s.filter("role = 'train'").select(*layout.keys(s, by), IDX, VALUE)
    truth = layout.join_series(s.filter("role = 'test'"), n.select(*by, "_train"), by).select(
        *by, (F.col(IDX) - F.col("_train") + 1).alias("step"), F.col(VALUE).alias("actual"))
    e = F.col("actual") - F.col("forecast")
    named = F.array(*[F.struct(F.lit(name).alias("method"), *[F.lit(int(v)).cast("long").alias(c) for c, v in zip("pdq", order)])
                      for name, order in orders.items()])
    asked = df.select(*by).distinct().withColumn("_o", F.explode(named)).select(*by, "_o.*")
    # one job fits the orders of all methods; a method or series without a fit keeps a row without errors
    fits = estimation.fit_orders(train, sorted(set(map(tuple, orders.values()))), by)
    keys = (*by, "method")
    fits = asked.join(fits, [*by, "p", "d", "q"]).join(n.select(*by, "horizon"), [*by])
    scored = forecasting.forecast_long(fits, "horizon", keys).join(truth, [*by, "step"]).groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.coalesce(F.avg(F.when(F.col("actual") != 0, F.abs(div(e, F.col("actual"))))) * 100,
                   F.lit(float("inf"))).alias("mape"))
    return asked.select(*keys).join(scored, [*keys], "left")
