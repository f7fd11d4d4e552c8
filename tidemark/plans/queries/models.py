"""Estimation and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.layout import IDX, SERIES, VALUE
from tidemark.operators import estimation, forecasting, recursion, regression
from tidemark.operators.accuracy import information_criteria
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import HOURLY, MONTHLY, REVENUE, USER

STEPS = 12
Z = 1.959963984540054

# AR(1) by hand: phi, variance, likelihood, everything forecasts need.
AR1 = """, l AS (SELECT *, lag(w) OVER (PARTITION BY series_id ORDER BY idx) AS l1 FROM c),
f0 AS (SELECT series_id, any_value(n) AS n, any_value(mean) AS mean, sum(w * l1) / sum(l1 * l1) AS phi,
 sum(w * w) FILTER (idx >= 1) - pow(sum(w * l1), 2) / sum(l1 * l1) AS rss, sum(l1 * l1) AS sxx,
 arg_max(w, idx) AS last_w FROM l GROUP BY 1),
f AS (SELECT *, rss / n AS sigma2, mean * (1 - phi) AS c, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM f0)
"""
FORECAST = f"""SELECT series_id, step, {r('mean + last_w * pow(phi, step)')} AS forecast,
{r(f'mean + last_w * pow(phi, step) - {Z} * sqrt(sigma2 * (1 - pow(phi, 2 * step)) / (1 - phi * phi))')} AS lower,
{r(f'mean + last_w * pow(phi, step) + {Z} * sqrt(sigma2 * (1 - pow(phi, 2 * step)) / (1 - phi * phi))')} AS upper
FROM f, (SELECT unnest(range(1, {STEPS + 1})) AS step)"""


@query("ols_gram", MONTHLY + f"""SELECT series_id, count(*) AS n, {r('regr_intercept(y, idx)')} AS beta_0, {r('regr_slope(y, idx)')} AS beta_1,
{r('(regr_syy(y, idx) - pow(regr_sxy(y, idx), 2) / regr_sxx(y, idx)) / 1000')} AS rss FROM s GROUP BY 1""")
def ols_gram(t):
    o = regression.ols_gram(t.monthly(), [F.lit(1.0), F.col(IDX)], F.col(VALUE))
    return o.select(SERIES, "n", F.col("beta")[0].alias("beta_0"), F.col("beta")[1].alias("beta_1"),
                    (F.col("rss") / 1000).alias("rss"))


@query("ar_fit", USER + AR1 + f"""SELECT series_id, n AS n_obs, {r('phi')} AS phi_1, {r('c')} AS c, {r('mean')} AS mean, {r('sigma2')} AS sigma2,
{r('ll')} AS log_likelihood, {r('4 - 2 * ll')} AS aic, {r('2 * ln(n) - 2 * ll')} AS bic, {r('4 - 2 * ll + 12.0 / (n - 3)')} AS aicc,
{r('sqrt(rss / n / sxx)')} AS se_1 FROM f""")
def ar_fit(t):
    f = estimation.ar_fit(t.ev_user(), [1])
    return f.select(SERIES, "n_obs", F.col("phi")[0].alias("phi_1"), "c", "mean", "sigma2", "log_likelihood", "aic", "bic", "aicc",
                    F.col("se")[0].alias("se_1"))


@query("ar_fit_long_series", REVENUE + AR1 + f"SELECT series_id, n AS n_obs, {r('phi')} AS phi_1, {r('sigma2')} AS sigma2, {r('ll')} AS log_likelihood FROM f")
def ar_fit_long_series(t):
    f = estimation.ar_fit(t.revenue(), [1])
    return f.select(SERIES, "n_obs", F.col("phi")[0].alias("phi_1"), "sigma2", "log_likelihood")


def _flat(fits):
    return fits.select(SERIES, "p", "d", "q", "success", "n_obs", F.get("phi", F.lit(0)).alias("phi_1"),
                       F.get("theta", F.lit(0)).alias("theta_1"), "c", "sigma2", "log_likelihood", "aic", "bic", "error")


# AR(1) around zero: no mean is taken off
AR1_NC = """, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS l1 FROM c),
f0 AS (SELECT series_id, any_value(n) AS n, sum(y * l1) / sum(l1 * l1) AS phi,
 sum(y * y) FILTER (idx >= 1) - pow(sum(y * l1), 2) / sum(l1 * l1) AS rss, arg_max(y, idx) AS last_y FROM l GROUP BY 1),
f AS (SELECT *, rss / n AS sigma2, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM f0)
"""


@query("ar_fit_no_constant", USER + AR1_NC + f"""SELECT series_id, n AS n_obs, {r('phi')} AS phi_1, 0.0::DOUBLE AS c, {r('sigma2')} AS sigma2,
{r('ll')} AS log_likelihood, {r('4 - 2 * ll')} AS aic, {r('2 * ln(n) - 2 * ll')} AS bic FROM f""")
def ar_fit_no_constant(t):
    f = estimation.ar_fit(t.ev_user(), [1], constant=False)
    return f.select(SERIES, "n_obs", F.col("phi")[0].alias("phi_1"), "c", "sigma2", "log_likelihood", "aic", "bic")


@query("ar_forecast_no_constant", USER + AR1_NC + f"""SELECT series_id, step, {r('last_y * pow(phi, step)')} AS forecast
FROM f, (SELECT unnest(range(1, {STEPS + 1})) AS step)""")
def ar_forecast_no_constant(t):
    f = estimation.ar_fit(t.ev_user(), [1], constant=False)
    return forecasting.model_forecast(f, STEPS).select(SERIES, "step", "forecast")


def ma1_search(base: str, centred: str = "w", levels: int = 6, points: int = 40) -> str:
    """MA(1) by hand: the filter as a recursive query over nested grids of theta, each a tenth as wide as the one before.

    The sum of squares is compared as it is; after the last level theta is known to about 1e-7.
    """
    out, step = base.replace("WITH base", "WITH RECURSIVE base", 1), 2 * 0.9999 / (2 * points)
    out += f", sz AS (SELECT series_id, max(idx) AS last, any_value(n) AS n, any_value(mean) AS mean FROM c GROUP BY 1), b0 AS (SELECT series_id, 0.0::DOUBLE AS th FROM sz)"
    for k in range(1, levels + 1):
        around = points if k == 1 else 12
        out += f""", g{k} AS (SELECT DISTINCT series_id, greatest(-0.9999, least(0.9999, th + i * {step!r})) AS th FROM b{k - 1}, (SELECT unnest(range({-around}, {around + 1})) AS i)),
e{k} AS (SELECT series_id, 0::BIGINT AS idx, th, 0.0::DOUBLE AS e, 0.0::DOUBLE AS rss FROM g{k}
 UNION ALL SELECT e.series_id, e.idx + 1, e.th, n.{centred} - e.th * e.e, e.rss + pow(n.{centred} - e.th * e.e, 2) FROM e{k} e JOIN c n ON n.series_id = e.series_id AND n.idx = e.idx + 1),
b{k} AS (SELECT series_id, arg_min(th, rss) AS th, min(rss) AS rss, arg_min(e, rss) AS shock FROM e{k} JOIN sz USING (series_id) WHERE idx = last GROUP BY 1)"""
        step /= 10
    return out + f", f AS (SELECT b{levels}.*, n, mean, rss / n AS sigma2, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM b{levels} JOIN sz USING (series_id))\n"


@query("ma_fit", ma1_search(USER) + f"""SELECT series_id, n AS n_obs, {r('th', 3)} AS theta_1, {r('mean', 3)} AS c, {r('sigma2', 3)} AS sigma2, {r('ll', 3)} AS log_likelihood,
{r('4 - 2 * ll', 3)} AS aic, {r('2 * ln(n) - 2 * ll', 3)} AS bic, true AS success FROM f""", 3)
def ma_fit(t):
    f = estimation.ma_fit(t.ev_user(), 1)
    return f.select(SERIES, "n_obs", F.col("theta")[0].alias("theta_1"), "c", "sigma2", "log_likelihood", "aic", "bic", "success")


@query("ma_fit_no_constant", ma1_search(USER, "y") + f"SELECT series_id, n AS n_obs, {r('th', 3)} AS theta_1, 0.0::DOUBLE AS c, {r('ll', 3)} AS log_likelihood FROM f", 3)
def ma_fit_no_constant(t):
    f = estimation.ma_fit(t.ev_user(), 1, constant=False)
    return f.select(SERIES, "n_obs", F.col("theta")[0].alias("theta_1"), "c", "log_likelihood")


@query("arma_fit")
def arma_fit(t):
    return _flat(estimation.arma_fit(t.ev_user(), 1, 1))


@query("arima_fit")
def arima_fit(t):
    return _flat(estimation.arima_fit(t.ev_user(), 1, 1, 1))


@query("model_fit")
def model_fit(t):
    f = estimation.model_fit(t.daily(), "ARIMA", (1, 1, 1), bounded=True)
    return _flat(f.drop("error").withColumn("error", F.col("warnings")))


@query("ma_order_aic")
def ma_order_aic(t):
    return estimation.ma_order_aic(t.hourly(), 4)


@query("arma_order_grid")
def arma_order_grid(t):
    return _flat(estimation.arma_order_grid(t.hourly(), 2, 2))


@query("verify_d")
def verify_d(t):
    s = t.hourly()
    return estimation.verify_d(s, s.select(SERIES).distinct().withColumn("d", F.lit(1)))


@query("arima_order_select")
def arima_order_select(t):
    return _flat(estimation.arima_order_select(t.hourly(), 2, 2))


@query("parallel_model_selection")
def parallel_model_selection(t):
    return _flat(estimation.parallel_model_selection(t.monthly(), 3, 1, 3)[1])


@query("model_explore")
def model_explore(t):
    return estimation.model_explore(t.ev_user()).drop("acf", "pacf")


# Given parameters: phi = 1/3, theta = 2/7 around the series mean, run as a recursive query.
ARMA_REC = USER.replace("WITH base", "WITH RECURSIVE base", 1) + """, lw AS (SELECT *, lag(w) OVER (PARTITION BY series_id ORDER BY idx) AS l1 FROM c),
e AS (SELECT series_id, idx, y, 0.0::DOUBLE AS e, w FROM lw WHERE idx = 0
 UNION ALL SELECT n.series_id, n.idx, n.y, n.w - (1::DOUBLE / 3) * n.l1 - (2::DOUBLE / 7) * e.e, n.w FROM e JOIN lw n ON n.series_id = e.series_id AND n.idx = e.idx + 1)
"""


def stored_params(t, phi=(1 / 3,), theta=(2 / 7,)):
    arr = lambda vs: F.array(*[F.lit(v) for v in vs]) if vs else F.array().cast("array<double>")
    return t.ev_user().groupBy(SERIES).agg(F.avg(VALUE).alias("mean")).select(
        SERIES, "mean", arr(phi).alias("phi"), arr(theta).alias("theta"))


@query("arma_residuals", ARMA_REC + f"SELECT series_id, idx, {r('e')} AS residual FROM e")
def arma_residuals(t):
    return recursion.arma_residuals(t.ev_user(), stored_params(t), 1).select(SERIES, IDX, "residual")


@query("fitted_values", ARMA_REC + f"SELECT series_id, idx, {r('y - e')} AS fitted FROM e")
def fitted_values(t):
    return recursion.fitted_values(t.ev_user(), stored_params(t), 1)


@query("css_loglik", ARMA_REC + f"""SELECT series_id, count(*) AS n, {r('sum(e * e)', 5)} AS rss, {r('sum(e * e) / count(*)', 5)} AS sigma2,
{r('-count(*) / 2.0 * (ln(2 * pi() * sum(e * e) / count(*)) + 1)', 5)} AS log_likelihood FROM e GROUP BY 1""", 5)
def css_loglik(t):
    return recursion.css_loglik(recursion.arma_residuals(t.ev_user(), stored_params(t), 1))


@query("ar_residuals", USER + AR1 + f"""SELECT l.series_id, l.idx, {r('CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END')} AS residual,
{r('y - CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END')} AS fitted FROM l JOIN f USING (series_id)""")
def ar_residuals(t):
    s = t.ev_user()
    return recursion.ar_residuals(s, estimation.ar_fit(s, [1]), 1).select(SERIES, IDX, "residual", "fitted")


@query("model_residuals", USER + AR1 + f"""SELECT l.series_id, l.idx, {r('CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END')} AS residual,
{r('y - CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END')} AS fitted FROM l JOIN f USING (series_id)""")
def model_residuals(t):
    s = t.ev_user()
    return recursion.model_residuals(s, estimation.ar_fit(s, [1])).select(SERIES, IDX, "residual", "fitted")


CANDIDATES = [round(-0.9 + 0.1 * i, 10) for i in range(19)]
CANDIDATE_ROWS = ", ".join(f"({v})" for v in CANDIDATES)
SEARCH = USER + f""", l AS (SELECT *, lag(w) OVER (PARTITION BY series_id ORDER BY idx) AS l1 FROM c),
ll AS (SELECT series_id, p, any_value(n) AS n, sum(CASE WHEN idx >= 1 THEN pow(w - p * l1, 2) ELSE 0 END) AS rss FROM l,
 (SELECT p::DOUBLE AS p FROM (VALUES {CANDIDATE_ROWS}) v(p)) GROUP BY 1, 2)
"""


@query("param_search", SEARCH + f"SELECT series_id, {r('max(-n / 2.0 * (ln(2 * pi() * rss / n) + 1))')} AS log_likelihood, {r('arg_min(p, rss)')} AS phi FROM ll GROUP BY 1")
def param_search(t):
    return estimation.param_search(t.ev_user(), CANDIDATES)


@query("grid_search", SEARCH + f"SELECT series_id, {r('min(rss)', 5)} AS value, {r('arg_min(p, rss)', 5)} AS phi FROM ll GROUP BY 1", 5)
def grid_search(t):
    rows = estimation.centred_lags(t.ev_user())

    def rss(point):
        e = F.when(F.col(IDX) >= 1, F.col("w") - point["phi"] * F.col("lag_1")).otherwise(0.0)
        return F.sum(e * e)

    return estimation.grid_search(rows, {"phi": CANDIDATES}, rss)


@query("std_errors", USER + AR1 + f"""SELECT series_id, 'phi_1' AS name, {r('phi')} AS estimate, {r('sqrt(rss / n / sxx)')} AS std_error,
{r('phi / sqrt(rss / n / sxx)')} AS t FROM f""")
def std_errors(t):
    return estimation.std_errors(estimation.ar_fit(t.ev_user(), [1]))


@query("params_map", USER + AR1 + f"""SELECT series_id, 'c' AS name, {r('c')} AS value FROM f UNION ALL SELECT series_id, 'sigma2', {r('sigma2')} FROM f
UNION ALL SELECT series_id, 'phi_1', {r('phi')} FROM f""")
def params_map(t):
    m = estimation.params_map(estimation.ar_fit(t.ev_user(), [1]))
    return m.select(SERIES, F.explode("params").alias("name", "value"))


@query("model_summary", HOURLY + AR1 + """SELECT series_id, concat_ws(chr(10), 'ARIMA(1,0,0)', 'Observations: ' || n, 'phi_1: ' || format('{:.4f}', phi),
'Constant: ' || format('{:.4f}', c), 'Sigma2: ' || format('{:.4f}', sigma2), 'Log-likelihood: ' || format('{:.4f}', ll),
'AIC: ' || format('{:.4f}', 4 - 2 * ll), 'BIC: ' || format('{:.4f}', 2 * ln(n) - 2 * ll)) AS summary FROM f""")
def model_summary(t):
    return estimation.model_summary(estimation.ar_fit(t.hourly(), [1]))


@query("model_metrics", USER + AR1 + f"""SELECT series_id, 'AR' AS family, 1::BIGINT AS p, 0::BIGINT AS d, 0::BIGINT AS q, {r('4 - 2 * ll')} AS aic,
{r('2 * ln(n) - 2 * ll')} AS bic, {r('ll')} AS log_likelihood, {r('sigma2')} AS sigma2 FROM f""")
def model_metrics(t):
    return estimation.model_metrics(estimation.ar_fit(t.ev_user(), [1]))


@query("information_criteria", USER + AR1 + f"""SELECT series_id, 1::BIGINT AS p, 0::BIGINT AS d, 0::BIGINT AS q, {r('4 - 2 * ll')} AS aic, {r('2 * ln(n) - 2 * ll')} AS bic,
{r('4 - 2 * ll + 12.0 / (n - 3)')} AS aicc, {r('4 * ln(ln(n)) - 2 * ll')} AS hqic FROM f""")
def criteria(t):
    return information_criteria(estimation.ar_fit(t.ev_user(), [1]))


# ------------------------------------------------------------ forecasts

@query("ar_forecast", USER + AR1 + FORECAST)
def ar_forecast(t):
    return forecasting.ar_forecast(t.ev_user(), 1, STEPS).drop("status", "engine_warnings")


@query("forecast_groups", USER + AR1 + FORECAST.replace("SELECT series_id, step,", "SELECT series_id, step, 'ok' AS status, '' AS engine_warnings,"))
def forecast_groups(t):
    return forecasting.forecast_groups(t.ev_user(), (1, 0, 0), STEPS)


@query("model_forecast", HOURLY + AR1 + FORECAST)
def model_forecast(t):
    return forecasting.model_forecast(estimation.ar_fit(t.hourly(), [1]), STEPS)


@query("forecast_interval", HOURLY + AR1 + FORECAST.replace(str(Z), "1.2815515655446004"))
def forecast_interval(t):
    return forecasting.model_forecast(estimation.ar_fit(t.hourly(), [1]), STEPS, 0.2)


STORED = ARMA_REC + """, tail AS (SELECT series_id, arg_max(w, idx) AS w, arg_max(e, idx) AS e FROM e GROUP BY 1),
m AS (SELECT series_id, any_value(mean) AS mean, any_value(n) AS n FROM c GROUP BY 1),
s2 AS (SELECT series_id, sum(e * e) / count(*) AS sigma2 FROM e GROUP BY 1),
p AS (SELECT tail.series_id, 1 AS step, w / 3 + 2 * e / 7 AS f, 1.0::DOUBLE AS psi, 1.0::DOUBLE AS v FROM tail
 UNION ALL SELECT series_id, step + 1, f / 3, CASE WHEN step = 1 THEN 1 / 3.0::DOUBLE + 2 / 7.0::DOUBLE ELSE psi / 3 END,
  v + pow(CASE WHEN step = 1 THEN 1 / 3.0::DOUBLE + 2 / 7.0::DOUBLE ELSE psi / 3 END, 2) FROM p WHERE step < 12)
"""
STORED_FORECAST = f"""SELECT series_id, step::BIGINT AS step, {r('mean + f')} AS forecast, {r(f'mean + f - {Z} * sqrt(v * sigma2)')} AS lower,
{r(f'mean + f + {Z} * sqrt(v * sigma2)')} AS upper FROM p JOIN m USING (series_id) JOIN s2 USING (series_id)"""


def stored_fits(t, phi=(1 / 3,), theta=(2 / 7,)):
    given = stored_params(t, phi, theta)
    spread = recursion.css_loglik(recursion.arma_residuals(t.ev_user(), given, 1))
    return given.join(spread.select(SERIES, "sigma2"), SERIES)


@query("predict_from_params", STORED + STORED_FORECAST)
def predict_from_params(t):
    f = forecasting.predict_from_params(t.ev_user(), stored_fits(t), STEPS, depth=1)
    return f.drop("status", "engine_warnings")


@query("arma_forecast", STORED + f"SELECT series_id, step::BIGINT AS step, {r('mean + f')} AS forecast FROM p JOIN m USING (series_id)")
def arma_forecast(t):
    """Given phi and theta, so that both engines forecast the same model."""
    f = forecasting.predict_from_params(t.ev_user(), stored_fits(t), STEPS, depth=1)
    return f.select(SERIES, "step", "forecast")


@query("ma_forecast", ARMA_REC.replace("- (1::DOUBLE / 3) * n.l1", "") + f"""SELECT c.series_id, step, {r('any_value(mean) + CASE WHEN step = 1 THEN 2 / 7.0::DOUBLE * arg_max(e, c.idx) ELSE 0 END')} AS forecast
FROM c JOIN e ON c.series_id = e.series_id AND c.idx = e.idx, (SELECT unnest(range(1, {STEPS + 1})) AS step) GROUP BY 1, 2""")
def ma_forecast(t):
    """theta = 2/7: one step from the last shock, then the mean."""
    f = forecasting.predict_from_params(t.ev_user(), stored_fits(t, ()), STEPS, depth=1)
    return f.select(SERIES, "step", "forecast")


D1 = USER.replace("c AS (SELECT *, y - avg(y)", "d AS (SELECT series_id, t, y AS level, y - lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS y, idx - 1 AS idx, n - 1 AS n FROM s QUALIFY idx >= 0),\nc AS (SELECT *, y - avg(y)").replace("AS mean FROM s)", "AS mean FROM d)")


@query("ma_forecast_fitted", USER + f"""SELECT series_id, step::BIGINT AS step, {r('avg(y) + 1e-9')} AS forecast FROM s, (SELECT unnest(range(3, {STEPS + 1})) AS step)
GROUP BY 1, 2""")
def ma_forecast_fitted(t):
    """MA(2): beyond two steps the forecast is the mean, whatever theta is."""
    return forecasting.ma_forecast(t.ev_user(), 2, STEPS).filter("step > 2").select(
        SERIES, "step", (F.col("forecast") + 1e-9).alias("forecast"))  # off the rounding edge of means of cents


@query("arima_forecast", D1 + AR1 + f""", lv AS (SELECT series_id, arg_max(level, idx) AS level FROM d GROUP BY 1),
st AS (SELECT series_id, step, level, mean * step + last_w * list_sum(list_transform(range(1, step + 1), lambda j: pow(phi, j))) AS up
 FROM f JOIN lv USING (series_id), (SELECT unnest(range(1, {STEPS + 1})) AS step))
SELECT series_id, step, {r('level + up')} AS forecast FROM st""")
def arima_forecast(t):
    """ARIMA(1, 1, 0): closed-form fit of the differences, cumulated from the last level."""
    return forecasting.arima_forecast(t.ev_user(), 1, 1, 0, STEPS).select(SERIES, "step", "forecast")


@query("log_back_transform", HOURLY.replace("avg(value) AS y", "ln(avg(value) + 5) AS y") + AR1 + FORECAST.replace(
    f"{r('mean + last_w * pow(phi, step)')} AS forecast", f"{r('exp(mean + last_w * pow(phi, step)) - 5')} AS forecast")
    .replace("round(mean", "round(-5 + exp(mean").replace("(1 - phi * phi)), 6)", "(1 - phi * phi))), 6)"))
def log_back_transform(t):
    s = t.hourly().withColumn(VALUE, F.log(F.col(VALUE) + 5))
    f = forecasting.model_forecast(estimation.ar_fit(s, [1]), STEPS).withColumn("log_c", F.lit(5.0))
    return forecasting.log_back_transform(f).drop("log_c")


@query("fit_groups")
def fit_groups(t):
    return _flat(estimation.fit_groups(t.ev_user(), (1, 1, 1)))


@query("predict_groups")
def predict_groups(t):
    p = forecasting.predict_groups(t.ev_user(), (1, 1, 1), STEPS)
    return p.select(SERIES, "success", F.posexplode_outer(F.arrays_zip("predictions", "lower_bound", "upper_bound")).alias("step", "z")) \
        .select(SERIES, "success", "step", "z.predictions", "z.lower_bound", "z.upper_bound")


# ------------------------------------------------------------ the same functions on models that SQL can fit

@query("ma1_forecast", ma1_search(USER, levels=8) + f"""SELECT series_id, step, {r('mean + CASE WHEN step = 1 THEN th * shock ELSE 0 END', 2)} AS forecast
FROM f, (SELECT unnest(range(1, 4)) AS step)""", 2)
def ma1_forecast(t):
    """MA(1): fitted theta carries the last shock one step."""
    return forecasting.ma_forecast(t.ev_user(), 1, 3).select(SERIES, "step", "forecast")


@query("arima011_fit", ma1_search(D1) + f"""SELECT series_id, n AS n_obs, {r('th', 3)} AS theta_1, {r('ll', 3)} AS log_likelihood, {r('4 - 2 * ll', 3)} AS aic, true AS success FROM f""", 3)
def arima011_fit(t):
    """ARIMA(0, 1, 1): many of these series end at the edge, theta = -0.9999."""
    f = estimation.arima_fit(t.ev_user(), 0, 1, 1)
    return f.select(SERIES, "n_obs", F.col("theta")[0].alias("theta_1"), "log_likelihood", "aic", "success")


@query("fit_groups_ima", ma1_search(D1) + f"SELECT series_id, 0::BIGINT AS p, 1::BIGINT AS d, 1::BIGINT AS q, {r('ll', 3)} AS log_likelihood, true AS success FROM f", 3)
def fit_groups_ima(t):
    return estimation.fit_groups(t.ev_user(), (0, 1, 1)).select(SERIES, "p", "d", "q", "log_likelihood", "success")


IMA = ma1_search(D1, levels=8) + f""", lv AS (SELECT series_id, arg_max(level, idx) AS level FROM d GROUP BY 1),
fc AS (SELECT series_id, step, level + mean * step + th * shock AS forecast, {Z} * sqrt(sigma2 * (1 + (step - 1) * (1 + th) * (1 + th))) AS half
 FROM f JOIN lv USING (series_id), (SELECT unnest(range(1, 4)) AS step))
"""


@query("arima011_forecast", IMA + f"SELECT series_id, step, {r('forecast', 1)} AS forecast, {r('forecast - half', 1)} AS lower, {r('forecast + half', 1)} AS upper FROM fc", 1)
def arima011_forecast(t):
    return forecasting.arima_forecast(t.ev_user(), 0, 1, 1, 3).select(SERIES, "step", "forecast", "lower", "upper")


@query("predict_groups_ima", IMA + f"SELECT series_id, step, {r('forecast', 1)} AS forecast, {r('forecast - half', 1)} AS lower FROM fc", 1)
def predict_groups_ima(t):
    p = forecasting.predict_groups(t.ev_user(), (0, 1, 1), 3)
    z = F.posexplode_outer(F.arrays_zip("predictions", "lower_bound")).alias("at", "z")
    return p.select(SERIES, z).select(SERIES, (F.col("at") + 1).cast("long").alias("step"), F.col("z.predictions").alias("forecast"),
                                      F.col("z.lower_bound").alias("lower"))


@query("predict_groups_ar", USER + AR1 + FORECAST)
def predict_groups_ar(t):
    p = forecasting.predict_groups(t.ev_user(), (1, 0, 0), STEPS)
    z = F.posexplode_outer(F.arrays_zip("predictions", "lower_bound", "upper_bound")).alias("at", "z")
    return p.select(SERIES, z).select(SERIES, (F.col("at") + 1).cast("long").alias("step"), F.col("z.predictions").alias("forecast"),
                                      F.col("z.lower_bound").alias("lower"), F.col("z.upper_bound").alias("upper"))


@query("fit_groups_ar", USER + AR1 + f"SELECT series_id, {r('phi')} AS phi_1, {r('ll')} AS log_likelihood, true AS success FROM f")
def fit_groups_ar(t):
    return estimation.fit_groups(t.ev_user(), (1, 0, 0)).select(SERIES, F.col("phi")[0].alias("phi_1"), "log_likelihood", "success")


@query("model_fit_ar", USER + AR1 + f"SELECT series_id, {r('phi')} AS phi_1, {r('4 - 2 * ll')} AS aic FROM f")
def model_fit_ar(t):
    return estimation.model_fit(t.ev_user(), "AR", (1, 0, 0)).select(SERIES, F.col("phi")[0].alias("phi_1"), "aic")


@query("model_fit_ma", ma1_search(USER) + f"SELECT series_id, {r('th', 3)} AS theta_1, {r('4 - 2 * ll', 3)} AS aic FROM f", 3)
def model_fit_ma(t):
    return estimation.model_fit(t.ev_user(), "MA", (0, 0, 1)).select(SERIES, F.col("theta")[0].alias("theta_1"), "aic")


# AR orders 1 and 2 from the same sums, the first values of order 1 added
AR_BOTH = AR1.replace("f0 AS", """l2 AS (SELECT *, lag(w, 2) OVER (PARTITION BY series_id ORDER BY idx) AS l2 FROM l),
g2 AS (SELECT series_id, any_value(n) AS n, sum(l1 * l1) AS a, sum(l1 * l2) AS b, sum(l2 * l2) AS c, sum(w * l1) AS d, sum(w * l2) AS e, sum(w * w) AS s
 FROM l2 WHERE idx >= 2 GROUP BY 1),
h2 AS (SELECT series_id, n, (d * c - b * e) / (a * c - b * b) AS p1, (a * e - b * d) / (a * c - b * b) AS p2, s, d, e FROM g2),
k2 AS (SELECT series_id, -n / 2.0 * (ln(2 * pi() * (s - p1 * d - p2 * e) / n) + 1) AS ll2 FROM h2),
f0 AS""", 1)


@query("parallel_model_selection_ar", USER + AR_BOTH + f"""SELECT series_id, CASE WHEN 4 - 2 * ll <= 6 - 2 * ll2 THEN 1 ELSE 2 END::BIGINT AS p,
{r('least(4 - 2 * ll, 6 - 2 * ll2)')} AS aic FROM f JOIN k2 USING (series_id)""")
def parallel_model_selection_ar(t):
    """Orders (1, 0, 0) and (2, 0, 0): the best of all fits by AIC."""
    return estimation.parallel_model_selection(t.ev_user(), 2, 0, 0)[1].select(SERIES, "p", "aic")


@query("arma_order_grid_ar", USER + AR_BOTH + f"""SELECT series_id, CASE WHEN 2 * ln(n) - 2 * ll <= 3 * ln(n) - 2 * ll2 THEN 1 ELSE 2 END::BIGINT AS p,
{r('least(2 * ln(n) - 2 * ll, 3 * ln(n) - 2 * ll2)')} AS bic FROM f JOIN k2 USING (series_id)""")
def arma_order_grid_ar(t):
    return estimation.arma_order_grid(t.ev_user(), 2, 0, "bic").select(SERIES, "p", "bic")
