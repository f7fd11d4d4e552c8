"""Accuracy, diagnostics, workflow steps, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions import probability as pr
from tidemark.layout import IDX, SERIES, VALUE
from tidemark.operators import (accuracy, correlation, diagnostics, estimation, forecasting, recursion, reports,
                                selection)
from tidemark.operators.cleaning import train_test_split
from tidemark.plans import workflow
from tidemark.plans.queries.algebra import FITS, NAIVE, forecast_pairs, naive_pairs, window_fits
from tidemark.plans.queries.common import query, r
from tidemark.plans.queries.models import AR1, STEPS
from tidemark.plans.series import HOURLY, USER

# ------------------------------------------------------------ accuracy

ERRORS = NAIVE + """, g AS (SELECT *, lag(actual) OVER o AS pa, lag(predicted) OVER o AS pp FROM e WINDOW o AS (PARTITION BY series_id ORDER BY step)),
m AS (SELECT series_id, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae,
 avg(abs((actual - predicted) / actual)) FILTER (actual <> 0) * 100 AS mape,
 avg(2 * abs(actual - predicted) / (abs(actual) + abs(predicted))) * 100 AS smape,
 avg(abs(actual - predicted)) / avg(coalesce(abs(actual - pa), 0)) AS mase,
 sqrt(avg(pow(actual - predicted, 2))) / (sqrt(avg(actual * actual)) + sqrt(avg(predicted * predicted))) AS theil_u,
 avg(((actual > pa) = (predicted > pp))::INT) AS directional_accuracy FROM g GROUP BY 1)
"""


def pairs(t):
    f = naive_pairs(t, 1)
    return f.select(SERIES, "step", "actual", F.col("forecast").alias("predicted"))


def _measure(name):
    @query(name, ERRORS + f"SELECT series_id, {r(name)} AS {name} FROM m")
    def run(t):
        return getattr(accuracy, name)(pairs(t))
    return run


MEASURES = ("rmse", "mae", "mape", "smape", "mase", "theil_u", "directional_accuracy")
for measure in MEASURES:
    _measure(measure)


@query("evaluate_forecast", ERRORS + "SELECT series_id, " + ", ".join(f"{r(m)} AS {m}" for m in MEASURES) + " FROM m")
def evaluate_forecast(t):
    return accuracy.evaluate_forecast(pairs(t))


def _criterion(name, sql):
    @query(name, USER + AR1 + f"SELECT series_id, {r(sql)} AS {name} FROM f")
    def run(t):
        return accuracy.information_criteria(estimation.ar_fit(t.ev_user(), [1])).select(SERIES, name)
    return run


_criterion("aic", "4 - 2 * ll")
_criterion("bic", "2 * ln(n) - 2 * ll")
_criterion("aicc", "4 - 2 * ll + 12.0 / (n - 3)")
_criterion("hqic", "4 * ln(ln(n)) - 2 * ll")


@query("forecast_distance", NAIVE + f"""SELECT series_id, {r('avg(abs(forecast_a - forecast_b))')} AS mae_diff, {r('sqrt(avg(pow(forecast_a - forecast_b, 2)))')} AS rmse_diff,
{r('avg(abs(forecast_a - forecast_b) / greatest(abs(forecast_a), 1e-12)) * 100')} AS mape_diff FROM pairs GROUP BY 1""")
def forecast_distance(t):
    return accuracy.forecast_distance(forecast_pairs(t))


@query("relative_deviation", NAIVE + f"""SELECT series_id, step, {r('100 * abs(forecast_b - forecast_a) / greatest(abs(forecast_a), 1e-12)')} AS deviation_pct FROM pairs""")
def relative_deviation(t):
    return accuracy.relative_deviation(forecast_pairs(t)).select(SERIES, "step", "deviation_pct")


@query("forecast_agreement", NAIVE + f""", k AS (SELECT series_id, 100 * greatest(0, least(1, 1 - avg(abs(forecast_a - forecast_b)) / greatest(avg(abs(forecast_a)), 1e-12))) AS s FROM pairs GROUP BY 1)
SELECT {r('avg(s)')} AS agreement_pct, count(*) AS num_series FROM k""")
def forecast_agreement(t):
    return accuracy.forecast_agreement(forecast_pairs(t))


# ------------------------------------------------------------ residual diagnostics of AR(1) per user

RES = USER + AR1 + """, res AS (SELECT l.series_id, l.idx, l.n, CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END AS e,
 y - CASE WHEN idx >= 1 THEN w - phi * l1 ELSE 0 END AS fitted FROM l JOIN f USING (series_id)),
rc AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id) AS x FROM res),
st AS (SELECT series_id, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, avg(pow(x, 3)) / pow(avg(x * x), 1.5) AS skewness,
 avg(pow(x, 4)) / pow(avg(x * x), 2) - 3 AS kurtosis FROM rc GROUP BY 1)
"""


def residuals(t):
    s = t.ev_user()
    return recursion.ar_residuals(s, estimation.ar_fit(s, [1]), 1)


@query("residual_stats", RES + f"SELECT series_id, n, {r('mean')} AS mean, {r('std')} AS std, {r('skewness')} AS skewness, {r('kurtosis')} AS kurtosis FROM st")
def residual_stats(t):
    return diagnostics.residual_stats(residuals(t))


@query("jarque_bera", RES + f"""SELECT series_id, {r('n / 6.0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4)')} AS jb_stat,
{r('exp(-n / 12.0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4))')} AS jb_p FROM st""")
def jarque_bera(t):
    return diagnostics.jarque_bera(residuals(t))


def poly_sql(coefs, x: str) -> str:
    text = f"({coefs[0]!r}::DOUBLE)"
    for c in coefs[1:]:
        text = f"({text} * {x} + {c})"
    return text


def cdf_sql(z: str) -> str:
    far = f"(abs({z}) + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"(abs({z}) + {k} / {far})"
    bell = f"exp(-{z} * {z} / 2)"
    tail = (f"(CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < {pr.NORMAL_FAR} THEN {bell} * {poly_sql(pr.NORMAL_NUM, f'abs({z})')} / "
            f"{poly_sql(pr.NORMAL_DEN, f'abs({z})')} ELSE {bell} / {far} / {pr.NORMAL_ROOT} END)")
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def quantile_sql(p: str) -> str:
    c, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"(CASE WHEN {p} < {pr.TAIL_FROM} THEN {poly_sql(pr.TAIL_NUM, low)} / {poly_sql(pr.TAIL_DEN, low)} "
            f"WHEN {p} > {1 - pr.TAIL_FROM} THEN -{poly_sql(pr.TAIL_NUM, high)} / {poly_sql(pr.TAIL_DEN, high)} "
            f"ELSE {c} * {poly_sql(pr.CENTRE_NUM, f'({c} * {c})')} / {poly_sql(pr.CENTRE_DEN, f'({c} * {c})')} END)")


@query("ks_normal", RES + f""", o AS (SELECT series_id, e, row_number() OVER (PARTITION BY series_id ORDER BY e) AS i, count(*) OVER k AS m,
 (e - avg(e) OVER k) / stddev_pop(e) OVER k AS z FROM res WINDOW k AS (PARTITION BY series_id)),
g AS (SELECT series_id, any_value(m) AS m, max(greatest(i / m - {cdf_sql('z')}, {cdf_sql('z')} - (i - 1) / m)) AS d FROM o GROUP BY 1),
h AS (SELECT series_id, d, d * (sqrt(m) + 0.12 + 0.11 / sqrt(m)) AS x FROM g)
SELECT series_id, {r('d')} AS ks_stat, {r("CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x))))) END")} AS ks_p FROM h""")
def ks_normal(t):
    return diagnostics.ks_normal(residuals(t))


SHAPIRO = RES + f""", o AS (SELECT series_id, e, row_number() OVER (PARTITION BY series_id ORDER BY e) AS i, count(*) OVER (PARTITION BY series_id) AS m FROM res),
q AS (SELECT *, (i - 0.375) / (m + 0.25) AS pr FROM o), qq AS (SELECT *, {quantile_sql('pr')} AS v FROM q),
b AS (SELECT series_id, any_value(m) AS m, sum(v * v) AS mm, sum(v * e) AS mx, var_pop(e) * count(*) AS ss, max(v) AS a1, max(v) FILTER (i = m - 1) AS a2,
 max(e) - min(e) AS ends, max(e) FILTER (i = m - 1) - max(e) FILTER (i = 2) AS inn FROM qq GROUP BY 1),
ls AS (SELECT *, {poly_sql((*diagnostics.ROYSTON_LAST, 'a1 / sqrt(mm)'), '(1 / sqrt(m))')} AS la, {poly_sql((*diagnostics.ROYSTON_NEXT, 'a2 / sqrt(mm)'), '(1 / sqrt(m))')} AS lb FROM b),
wv AS (SELECT series_id, m, least(1, pow(la * ends + lb * inn + (mx - a1 * ends - a2 * inn) / sqrt((mm - 2 * a1 * a1 - 2 * a2 * a2) / (1 - 2 * la * la - 2 * lb * lb)), 2) / ss) AS w FROM ls),
yv AS (SELECT *, ln(1 - w) AS y, ln(m) AS lm FROM wv),
zv AS (SELECT *, -(y - {poly_sql(diagnostics.ROYSTON_LARGE_MU, 'lm')}) / exp({poly_sql(diagnostics.ROYSTON_LARGE_SD, 'lm')}) AS z FROM yv)
"""


@query("shapiro_wilk", SHAPIRO + f"SELECT series_id, {r('w')} AS shapiro_stat, {r(cdf_sql('z'))} AS shapiro_p FROM zv")
def shapiro_wilk(t):
    """Series of 12 rows and more, which all of these are."""
    return diagnostics.shapiro_wilk(residuals(t))


def lag_corr_sql(source: str, keys: str = "series_id") -> str:
    using = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f""", kn AS (SELECT {keys}, count(*) AS m FROM {source} GROUP BY ALL),
lc AS (SELECT {own}, k.lag, coalesce(corr(a.e, b.e), 0) AS r FROM {source} a JOIN {source} b ON {using}
 JOIN (SELECT unnest(range(1, 11)) AS lag) k ON b.idx = a.idx - k.lag GROUP BY ALL),
lk AS (SELECT lc.*, m, least(10, m // 4) AS depth FROM lc JOIN kn USING ({keys})),
lb AS (SELECT {keys}, any_value(m) AS m, any_value(depth) AS depth, any_value(m) * (any_value(m) + 2) * sum(r * r / (m - lag)) FILTER (lag <= depth) AS stat,
 count(*) FILTER (lag <= depth AND abs(r) > 1.96 / sqrt(m)) AS peaks FROM lk GROUP BY ALL)
"""


CHI10 = "exp(-stat / 2) * (1 + stat / 2 + pow(stat / 2, 2) / 2 + pow(stat / 2, 3) / 6 + pow(stat / 2, 4) / 24)"


@query("lag_correlation", RES + lag_corr_sql("res") + f"SELECT series_id, lag, {r('r')} AS r FROM lc")
def lag_correlation(t):
    return diagnostics.lag_correlation(residuals(t))


@query("ljung_box", RES + lag_corr_sql("res") + f"SELECT series_id, {r('stat')} AS lb_stat, depth AS lb_lags, {r(CHI10)} AS lb_p FROM lb")
def ljung_box(t):
    return diagnostics.ljung_box(residuals(t))


@query("residual_acf_pass", RES + lag_corr_sql("res") + "SELECT series_id, peaks AS acf_peaks, peaks <= 2 AS acf_pass FROM lb")
def residual_acf_pass(t):
    return diagnostics.residual_acf_pass(residuals(t))


@query("breusch_pagan", RES + f"SELECT series_id, {r('regr_r2(e * e, fitted)')} AS bp_r2, {r('count(*) * regr_r2(e * e, fitted)')} AS bp_stat FROM res GROUP BY 1")
def breusch_pagan(t):
    return diagnostics.breusch_pagan(residuals(t)).drop("bp_p")


@query("residual_report", RES + lag_corr_sql("res") + f"""SELECT st.series_id, n, {r('mean')} AS mean, {r('std')} AS std, {r('skewness')} AS skewness, {r('kurtosis')} AS kurtosis,
{r('n / 6.0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4)')} AS jb_stat, {r('stat')} AS lb_stat, {r(CHI10)} AS lb_p, peaks AS acf_peaks, peaks <= 2 AS acf_pass,
{r('bp')} AS bp_stat FROM st JOIN lb USING (series_id) JOIN (SELECT series_id, count(*) * regr_r2(e * e, fitted) AS bp FROM res GROUP BY 1) USING (series_id)""")
def residual_report(t):
    rep = diagnostics.residual_report(residuals(t))
    return rep.select(SERIES, "n", "mean", "std", "skewness", "kurtosis", "jb_stat", "lb_stat", "lb_p", "acf_peaks", "acf_pass", "bp_stat")


EVALUATION = RES + lag_corr_sql("res") + """, er AS (SELECT series_id, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
 sqrt(avg(e * e)) / (sqrt(avg((fitted + e) * (fitted + e))) + sqrt(avg(fitted * fitted))) AS theil_u FROM res GROUP BY 1)
"""


@query("evaluate_model", EVALUATION + f"""SELECT f.series_id, 'AR' AS family, 1::BIGINT AS p, 0::BIGINT AS q, 2::BIGINT AS n_parameters, f.n AS n_obs, {r('4 - 2 * ll')} AS aic,
{r('2 * ln(f.n) - 2 * ll')} AS bic, {r('4 - 2 * ll + 12.0 / (f.n - 3)')} AS aicc, {r('ll')} AS log_likelihood, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('theil_u')} AS theil_u,
{r('st.mean')} AS residual_mean, {r('std')} AS residual_std, {r('skewness')} AS skewness, {r('kurtosis')} AS kurtosis, {r('lb.stat')} AS lb_stat, peaks AS acf_peaks
FROM f JOIN st USING (series_id) JOIN lb USING (series_id) JOIN er USING (series_id)""")
def evaluate_model(t):
    """In-sample evaluation of AR(1) fits: one row a model."""
    s = t.ev_user()
    fits = layout.durable(estimation.ar_fit(s, [1]))
    rows = layout.durable(recursion.model_residuals(s, fits))  # every measure and diagnostic reads them
    pairs = rows.select(SERIES, IDX, F.col(VALUE).alias("actual"), F.col("fitted").alias("predicted"))
    return estimation.evaluate_model(fits, rows, pairs).select(
        SERIES, "family", "p", "q", "n_parameters", "n_obs", "aic", "bic", "aicc", "log_likelihood", "rmse", "mae", "theil_u",
        "residual_mean", "residual_std", "skewness", "kurtosis", "lb_stat", "acf_peaks")


# ------------------------------------------------------------ workflow

@query("wf_prepare")
def wf_prepare(t):
    rows, state = workflow.wf_prepare(t.ev_user(), "AR")
    n = rows.groupBy(SERIES).agg(F.count("*").alias("rows_left"), F.avg(VALUE).alias("mean"))
    return state.drop("levels").join(n, SERIES)


@query("wf_grid_mode", """SELECT event_type AS series_id, count(*) AS n, CASE WHEN count(*) < 500 THEN 3 ELSE 5 END::BIGINT AS max_p,
CASE WHEN count(*) < 500 THEN 3 ELSE 5 END::BIGINT AS max_q FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) FROM events) GROUP BY 1""")
def wf_grid_mode(t):
    return workflow.wf_grid_mode(t.hourly(), None, "auto_n")


@query("wf_grid_mode_acf")
def wf_grid_mode_acf(t):
    s = t.hourly()
    return workflow.wf_grid_mode(s, s.select(SERIES).distinct().withColumn("d", F.lit(0)), "acf_pacf")


@query("wf_orders", """WITH k AS (SELECT user_id::VARCHAR AS series_id, count(*) AS n, count(*) % 3 AS d FROM events GROUP BY 1),
o AS (SELECT series_id, d, unnest(range(0, CASE WHEN n < 500 THEN 4 ELSE 6 END)) AS p, CASE WHEN n < 500 THEN 3 ELSE 5 END AS mq FROM k),
g AS (SELECT series_id, d, p, unnest(range(0, mq + 1)) AS q FROM o)
SELECT series_id, p, d, q FROM g WHERE p + q > 0""")
def wf_orders(t):
    s = t.ev_user()
    state = s.groupBy(SERIES).agg((F.count("*") % 3).alias("d"))
    return workflow.wf_orders(workflow.wf_grid_mode(s, state), state)


def _manual(t, top):
    s = t.hourly()
    grid = workflow.wf_grid_mode(s, None, "manual", top, top)
    return s, grid


PLAN_COUNT = ("(CASE WHEN n < 500 THEN greatest(3, least(5, n // 100)) WHEN n < 2000 THEN greatest(5, least(10, n // 150)) "
              "ELSE greatest(10, least(20, n // 150)) END)")
PLAN_OVERLAP = "(CASE WHEN n < 500 THEN 0.3 WHEN n < 2000 THEN 0.2 ELSE 0.15 END)::DOUBLE"
PLAN_FIXED = ("(CASE WHEN n < 500 THEN greatest(3, n // 150) WHEN n < 2000 THEN greatest(4, n // 200) "
              "ELSE greatest(5, n // 250) END)")
SLIDING = (FITS.replace(USER, HOURLY)
           .replace("n / (3 * 0.7 + 0.3)", f"n / ({PLAN_COUNT} * (1 - {PLAN_OVERLAP}) + {PLAN_OVERLAP})")
           .replace("floor(n / 8)", f"floor(n / ({PLAN_COUNT} + 5))")
           .replace("floor(size * 0.7)", f"floor(size * (1 - {PLAN_OVERLAP}))")
           .replace("least(3, floor", f"least({PLAN_COUNT}, floor"))


@query("wf_sliding_fit", SLIDING + f"""SELECT series_id, window_id, p, d, q, m >= 30 AS success, {r('CASE WHEN m >= 30 THEN aic END')} AS aic, {r("CASE WHEN m >= 30 THEN aicc ELSE 'inf'::DOUBLE END")} AS aicc FROM fits WHERE p >= 1""")
def wf_sliding_fit(t):
    """The AR family up to order 2 on the planned windows of the hourly series."""
    s, grid = _manual(t, 2)
    fits = workflow.wf_sliding_fit(s, workflow.wf_orders(grid, None, "AR"), "AR")
    return fits.select(SERIES, "window_id", "p", "d", "q", "success", "aic", "aicc")


@query("wf_sliding_fit_arima")
def wf_sliding_fit_arima(t):
    s, grid = _manual(t, 2)
    state = s.select(SERIES).distinct().withColumn("d", F.lit(1))
    fits = workflow.wf_sliding_fit(s, workflow.wf_orders(grid, state), "ARIMA")
    return fits.select(SERIES, "window_id", "p", "d", "q", "success", "aicc", "error")


@query("wf_select", FITS + f"""SELECT b.series_id, p, d, q, {r('score')} AS score,
{r('0.6 * count / num_windows + 0.4 * CASE WHEN rank_std > 0 THEN 1 / (1 + rank_std) ELSE 1 END')} AS confidence FROM best b JOIN nw USING (series_id) WHERE pos = 1""")
def wf_select(t):
    return workflow.wf_select(window_fits(t))[1].select(SERIES, "p", "d", "q", "score", "confidence")


@query("wf_reconcile")
def wf_reconcile(t):
    s, grid = _manual(t, 2)
    state = s.select(SERIES).distinct().withColumn("d", F.lit(0))
    fits = workflow.wf_sliding_fit(s, workflow.wf_orders(grid, state, "ARMA"), "ARMA")
    return workflow.wf_reconcile(s, selection.score_orders(fits))


FIXED_AR1 = HOURLY + f""", z AS (SELECT *, greatest(n // {PLAN_FIXED}, floor(11 / 0.7)::BIGINT + 10) AS size FROM s),
zw AS (SELECT *, least({PLAN_FIXED}, n // size + CASE WHEN n % size >= floor(11 / 0.7)::BIGINT + 10 THEN 1 ELSE 0 END) AS windows FROM z),
fi AS (SELECT *, least(idx // size, windows - 1) AS window_id FROM zw WHERE windows > 0),
fw AS (SELECT *, CASE WHEN window_id = windows - 1 THEN n - window_id * size ELSE size END AS len FROM fi),
kw AS (SELECT series_id, window_id, idx - window_id * size AS idx, y, floor(len * 0.7::DOUBLE)::BIGINT AS train_size, len FROM fw),
tr AS (SELECT *, y - avg(y) OVER k AS w, avg(y) OVER k AS mean, count(*) OVER k AS m FROM kw WHERE idx < train_size WINDOW k AS (PARTITION BY series_id, window_id)),
lt AS (SELECT *, lag(w) OVER (PARTITION BY series_id, window_id ORDER BY idx) AS l1 FROM tr),
fa AS (SELECT series_id, window_id, any_value(mean) AS mean, any_value(m) AS m, sum(w * l1) / sum(l1 * l1) AS phi, arg_max(w, idx) AS last_w,
  any_value(train_size) AS train_size, any_value(len) - any_value(train_size) AS test_size FROM lt GROUP BY 1, 2)
"""


def _ar1_orders(s):
    one = lambda v: F.lit(v).cast("long")
    return s.select(SERIES).distinct().select(SERIES, one(1).alias("p"), one(0).alias("d"), one(0).alias("q"))


@query("wf_backtest", FIXED_AR1 + f""", te AS (SELECT kw.series_id, kw.window_id, kw.y, fa.mean + fa.last_w * pow(fa.phi, idx - fa.train_size + 1) AS f
 FROM kw JOIN fa USING (series_id, window_id) WHERE idx >= fa.train_size),
sc AS (SELECT series_id, window_id, avg(abs(y - f)) AS mae, sqrt(avg(pow(y - f, 2))) AS rmse, avg(abs((y - f) / y)) FILTER (y <> 0) * 100 AS mape FROM te GROUP BY 1, 2)
SELECT series_id, window_id, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mape')} AS mape, {r('phi')} AS phi_1, train_size, test_size FROM sc JOIN fa USING (series_id, window_id)""")
def wf_backtest(t):
    s = t.hourly()
    b = workflow.wf_backtest(s, _ar1_orders(s))
    return b.select(SERIES, "window_id", "mae", "rmse", "mape", F.col("phi")[0].alias("phi_1"), "train_size", "test_size")


@query("wf_diagnose", FIXED_AR1 + """, res AS (SELECT lt.series_id, lt.window_id, lt.idx, lt.w - phi * l1 AS e FROM lt JOIN fa USING (series_id, window_id) WHERE lt.idx >= 1)
""" + lag_corr_sql("res", "series_id, window_id") + f"""SELECT series_id, window_id, {r('stat')} AS ljung_box_statistic, {r(CHI10)} AS ljung_box_p_value,
peaks AS acf_significant_peaks, {CHI10} > 0.05 AND peaks <= 2 AS overall_pass FROM lb""")
def wf_diagnose(t):
    s = t.hourly()
    d = workflow.wf_diagnose(s, _ar1_orders(s))
    return d.select(SERIES, "window_id", "ljung_box_statistic", "ljung_box_p_value", "acf_significant_peaks", "overall_pass")


@query("pass_rates", FIXED_AR1 + """, res AS (SELECT lt.series_id, lt.window_id, lt.idx, lt.w - phi * l1 AS e FROM lt JOIN fa USING (series_id, window_id) WHERE lt.idx >= 1)
""" + lag_corr_sql("res", "series_id, window_id") + f"""SELECT series_id, {r(f'avg(({CHI10} > 0.05 AND peaks <= 2)::INT)')} AS overall_pass_rate,
{r(f'avg(({CHI10} > 0.05)::INT)')} AS ljung_box_pass_rate, {r('avg((peaks <= 2)::INT)')} AS acf_pass_rate FROM lb GROUP BY 1""")
def pass_rates(t):
    s = t.hourly()
    return diagnostics.pass_rates(workflow.wf_diagnose(s, _ar1_orders(s)))


@query("wf_adjust")
def wf_adjust(t):
    """Every window counts as failed, so that every series tries its neighbours."""
    s = t.hourly()
    failed = s.groupBy(SERIES, F.expr(f"{IDX} div 100").alias("window_id")).agg(F.lit(False).alias("overall_pass"))
    return workflow.wf_adjust(s, _ar1_orders(s), failed)


@query("wf_fit")
def wf_fit(t):
    res = workflow.wf_fit(t.monthly(), "ARIMA", "manual", 2, 1)
    return res.fits.select(SERIES, "p", "d", "q", "success", "aic", "sigma2", "n_obs")


@query("wf_forecast")
def wf_forecast(t):
    return workflow.wf_forecast(workflow.wf_fit(t.daily(), "AR", "auto_n", bounded=True), STEPS)


@query("wf_results")
def wf_results(t):
    return workflow.wf_results(workflow.wf_fit(t.hourly(), "ARMA", "manual", 1, 1))


# ------------------------------------------------------------ report tables

@query("residual_histogram", RES + """, b AS (SELECT series_id, e, least(30, greatest(10, count(*) OVER k // 5)) AS bins, min(e) OVER k AS lo, max(e) OVER k AS hi
 FROM res WINDOW k AS (PARTITION BY series_id))
SELECT series_id, least(floor((e - lo) / (hi - lo) * bins)::BIGINT, bins - 1) AS bin, count(*) AS count FROM b GROUP BY 1, 2""")
def residual_histogram(t):
    return reports.residual_histogram(residuals(t))


def quantile_sql(p: str) -> str:
    poly = _horner
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    c = f"({p} - 0.5)"
    return (f"CASE WHEN {p} < {pr.TAIL_FROM} THEN {poly(pr.TAIL_NUM, low)} / {poly(pr.TAIL_DEN, low)} "
            f"WHEN {p} > {1 - pr.TAIL_FROM} THEN -{poly(pr.TAIL_NUM, high)} / {poly(pr.TAIL_DEN, high)} "
            f"ELSE {c} * {poly(pr.CENTRE_NUM, f'({c} * {c})')} / {poly(pr.CENTRE_DEN, f'({c} * {c})')} END")


def _horner(coefs, x):
    text = f"({coefs[0]}::DOUBLE)"
    for c in coefs[1:]:
        text = f"({text} * {x} + ({c}::DOUBLE))"
    return text


@query("qq_points", RES + f""", o AS (SELECT series_id, e, row_number() OVER (PARTITION BY series_id ORDER BY e) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM res),
pp AS (SELECT *, greatest(1e-6, least(1 - 1e-6, (idx + 0.625::DOUBLE) / (n + 0.25::DOUBLE))) AS p FROM o),
qs AS (SELECT series_id, quantile_cont(e, 0.25) AS a, quantile_cont(e, 0.75) AS b FROM res GROUP BY 1),
th AS (SELECT *, {quantile_sql('p')} AS z, {quantile_sql('0.75::DOUBLE')} AS q75 FROM pp JOIN qs USING (series_id))
SELECT series_id, idx, {r('z')} AS theoretical, {r('e')} AS sample, {r('a + (b - a) / (2 * q75) * q75 + (b - a) / (2 * q75) * z')} AS line FROM th""")
def qq_points(t):
    return reports.qq_points(residuals(t))


@query("standardized_residuals", RES + f"""SELECT series_id, idx, {r('e / stddev_pop(e) OVER k')} AS z, abs(e / stddev_pop(e) OVER k) > 2 AS outside FROM res WINDOW k AS (PARTITION BY series_id)""")
def standardized_residuals(t):
    return reports.standardized_residuals(residuals(t))


@query("residual_acf_table", RES + f""", v0 AS (SELECT series_id, sum(x * x) AS c0, count(*) AS n FROM rc GROUP BY 1)
SELECT a.series_id, k.lag, {r('coalesce(sum(a.x * b.x), 0) / any_value(c0)')} AS acf, {r('1.96 / sqrt(any_value(v0.n))')} AS bound FROM rc a JOIN v0 USING (series_id)
CROSS JOIN (SELECT unnest(range(0, 21)) AS lag) k LEFT JOIN rc b ON b.series_id = a.series_id AND b.idx = a.idx - k.lag GROUP BY 1, 2""")
def residual_acf_table(t):
    return reports.residual_acf_table(residuals(t))


@query("error_by_horizon", NAIVE + f"SELECT step, {r('avg(abs(actual - predicted))', 8)} AS error, count(*) AS n FROM e GROUP BY 1", 8)
def error_by_horizon(t):
    return reports.error_by_horizon(pairs(t))


@query("forecast_comparison_table", NAIVE + f"""SELECT series_id, step, {r('forecast_a')} AS forecast_a, {r('forecast_b')} AS forecast_b, {r('abs(forecast_b - forecast_a)')} AS abs_diff,
{r('100 * abs(forecast_b - forecast_a) / greatest(abs(forecast_a), 1e-12)')} AS pct_diff FROM pairs""")
def forecast_comparison_table(t):
    return reports.forecast_comparison_table(forecast_pairs(t))


def _band(z):
    return f"{z} * sqrt(sigma2 * (1 - pow(phi, 2 * step)) / (1 - phi * phi))"


@query("fan_bands", USER + AR1 + f"""SELECT series_id, step, {r('mean + last_w * pow(phi, step)')} AS forecast,
{r(f'mean + last_w * pow(phi, step) - {_band(1.2815515655446004)}')} AS lower_80, {r(f'mean + last_w * pow(phi, step) + {_band(1.2815515655446004)}')} AS upper_80,
{r(f'mean + last_w * pow(phi, step) - {_band(0.6744897501960817)}')} AS lower_50, {r(f'mean + last_w * pow(phi, step) + {_band(0.6744897501960817)}')} AS upper_50
FROM f, (SELECT unnest(range(1, {STEPS + 1})) AS step)""")
def fan_bands(t):
    return reports.fan_bands(estimation.ar_fit(t.ev_user(), [1]), STEPS)


@query("aicc_heatmap", FITS + f"SELECT series_id, p, {r('min(aicc)')} AS q0 FROM fits WHERE success GROUP BY 1, 2")
def aicc_heatmap(t):
    return reports.aicc_heatmap(window_fits(t), 0)


@query("window_rank_boxplot", FITS + f"""SELECT series_id, p, d, q, min(rank)::DOUBLE AS low, {r('quantile_cont(rank, 0.25)')} AS q1, {r('quantile_cont(rank, 0.5)')} AS median,
{r('quantile_cont(rank, 0.75)')} AS q3, max(rank)::DOUBLE AS high FROM ranks GROUP BY 1, 2, 3, 4""")
def window_rank_boxplot(t):
    return reports.window_rank_boxplot(selection.rank_in_window(window_fits(t)))


@query("method_accuracy_table")
def method_accuracy_table(t):
    orders = {"AR(1)": (1, 0, 0), "MA(1)": (0, 0, 1), "ARIMA(1,1,1)": (1, 1, 1)}
    return workflow.method_accuracy(t.hourly(), orders, bounded=True)


@query("diagnostic_tables")
def diagnostic_tables(t):
    """Training part of each hourly series under ARIMA(1, 0, 1): correlations, residual and Q-Q points."""
    s = train_test_split(t.hourly()).filter("role = 'train'").select(SERIES, IDX, VALUE)
    res = recursion.model_residuals(s, estimation.fit_orders(s, [(1, 0, 1)]), max_p=1)
    a = correlation.by_lag(correlation.pacf_from_acf(correlation.acf(s, 20)), "acf", "pacf")
    point = lambda d, table, at, one, two: d.select(F.lit(table).alias("table_name"), SERIES, F.col(at).alias("position"),
                                                   F.col(one).alias("a"), F.col(two).alias("b"))
    return (point(a, "correlations", "lag", "acf", "pacf")
            .unionByName(point(res, "residuals", IDX, "residual", "fitted"))
            .unionByName(point(reports.qq_points(res), "qq", IDX, "theoretical", "sample")))


@query("series_with_forecast", USER + AR1 + f"""SELECT series_id, idx, {r('y')} AS y, 'history' AS kind FROM s
UNION ALL SELECT series_id, n - 1 + step, {r('mean + last_w * pow(phi, step)')}, 'forecast' FROM f, (SELECT unnest(range(1, {STEPS + 1})) AS step)""")
def series_with_forecast(t):
    s = t.ev_user()
    return reports.series_with_forecast(s, forecasting.model_forecast(estimation.ar_fit(s, [1]), STEPS))
