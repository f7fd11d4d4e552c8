"""Correlation, order identification, stationarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.layout import SERIES
from tidemark.operators import correlation, estimation, stationarity
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import HOURLY, MONTHLY, REVENUE, USER


def rho_sql(lags: int, base: str) -> str:
    """``rho``: (series_id, n, lag, r), every lag by a self join."""
    return base + f""", v AS (SELECT series_id, any_value(n) AS n, sum(w * w) AS c0 FROM c GROUP BY 1),
rho AS (SELECT v.series_id, any_value(v.n) AS n, k.lag, coalesce(sum(a.w * b.w), 0) / any_value(c0) AS r FROM v
 JOIN (SELECT unnest(range(0, {lags + 1})) AS lag) k ON k.lag < v.n JOIN c a ON a.series_id = v.series_id
 LEFT JOIN c b ON b.series_id = a.series_id AND b.idx = a.idx - k.lag GROUP BY v.series_id, k.lag)
"""


# Durbin-Levinson as a recursive query: one row per order with its coefficients as a list.
def levinson_sql(depth: str) -> str:
    return f""", arr AS (SELECT series_id, any_value(n) AS n, list(r ORDER BY lag) AS rr FROM rho GROUP BY 1),
dl AS (SELECT series_id, n, rr, 1 AS k, [rr[2]] AS phi, rr[2] AS f FROM arr
 UNION ALL
 SELECT series_id, n, rr, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - g * phi[k + 1 - j]), g), g FROM (
  SELECT *, CASE WHEN abs(1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rr[j + 1]))) < 1e-10 THEN 0 ELSE
   (rr[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rr[k + 2 - j])))
   / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rr[j + 1]))) END AS g FROM dl WHERE k < {depth}))
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH base", "WITH RECURSIVE base", 1)


@query("acf", rho_sql(40, HOURLY) + f"SELECT series_id, lag, {r('r')} AS acf FROM rho WHERE lag <= least(n // 4, 40)")
def acf(t):
    return correlation.by_lag(correlation.acf(t.hourly()), "acf")


@query("acf_long_series", rho_sql(40, REVENUE) + f"SELECT series_id, lag, {r('r')} AS acf FROM rho")
def acf_long_series(t):
    return correlation.by_lag(correlation.acf(t.revenue(), 40), "acf")


PACF = recursive(rho_sql(40, MONTHLY) + levinson_sql("least(n // 4, 40)"))


@query("pacf", PACF + f"SELECT series_id, k::BIGINT AS lag, {r('f')} AS pacf FROM dl UNION ALL SELECT DISTINCT series_id, 0, 1.0 FROM dl")
def pacf(t):
    return correlation.by_lag(correlation.pacf(t.monthly()), "pacf")


@query("acf_pacf_summary", PACF + f"""SELECT series_id, any_value(n) AS n, {r('1.96 / sqrt(any_value(n))')} AS bound,
coalesce(min(k) FILTER (abs(f) > 1.96 / sqrt(n)), 0)::BIGINT AS suggested_p,
(SELECT coalesce(min(lag), 0) FROM rho WHERE rho.series_id = dl.series_id AND lag >= 1 AND lag <= least(rho.n // 4, 40)
 AND abs(r) > 1.96 / sqrt(rho.n))::BIGINT AS suggested_q FROM dl GROUP BY series_id""")
def acf_pacf_summary(t):
    return correlation.acf_pacf_summary(t.monthly()).drop("acf", "pacf")


@query("order_bounds", PACF + """, bart AS (SELECT series_id, n, lag, abs(r) > 1.959963984540054 * sqrt((1 + 2 * (sum(CASE WHEN lag >= 1 THEN r * r ELSE 0 END)
  OVER (PARTITION BY series_id ORDER BY lag) - CASE WHEN lag >= 1 THEN r * r ELSE 0 END)) / n) AS over FROM rho),
q AS (SELECT series_id, n, max(lag) FILTER (over AND lag BETWEEN 1 AND least(n // 4, 40)) AS last_q FROM bart GROUP BY 1, 2),
p AS (SELECT series_id, max(k) FILTER (abs(f) > 1.959963984540054 / sqrt(n)) AS last_p FROM dl GROUP BY 1)
SELECT series_id, n, greatest(1, least(coalesce(last_p, 1), least(greatest(1, n // 10), 5)))::BIGINT AS max_p,
greatest(1, least(coalesce(last_q, 1), least(greatest(1, n // 10), 5)))::BIGINT AS max_q FROM q JOIN p USING (series_id)""")
def order_bounds(t):
    return correlation.order_bounds(t.monthly())


@query("ar_order_pacf", PACF + """SELECT series_id, least(coalesce(max(k) FILTER (abs(f) > 1.96 / sqrt(n)), 0), 5)::BIGINT AS p FROM dl GROUP BY 1""")
def ar_order_pacf(t):
    return correlation.ar_order_pacf(t.monthly())


@query("ma_order_acf", rho_sql(40, USER) + """SELECT series_id, least(coalesce(max(lag) FILTER (abs(r) > 1.96 / sqrt(n) AND lag >= 1
AND lag <= least(n // 4, 40)), 0), 5)::BIGINT AS q FROM rho GROUP BY 1""")
def ma_order_acf(t):
    return correlation.ma_order_acf(t.ev_user())


@query("yule_walker", rho_sql(2, USER) + f""", k AS (SELECT series_id, max(r) FILTER (lag = 1) AS r1, max(r) FILTER (lag = 2) AS r2 FROM rho GROUP BY 1)
SELECT series_id, {r('(r1 - r1 * r2) / (1 - r1 * r1)')} AS phi_1, {r('(r2 - r1 * r1) / (1 - r1 * r1)')} AS phi_2 FROM k""")
def yule_walker(t):
    return correlation.yule_walker(t.ev_user(), 2).select(SERIES, F.col("phi")[0].alias("phi_1"), F.col("phi")[1].alias("phi_2"))


@query("ma_moments", rho_sql(3, USER) + f"SELECT series_id, lag, {r('greatest(least(r, 0.99), -0.99)')} AS theta FROM rho WHERE lag >= 1")
def ma_moments(t):
    return correlation.ma_moments(t.ev_user(), 3).select(SERIES, F.posexplode("theta").alias("lag", "theta")) \
        .withColumn("lag", F.col("lag") + 1)


@query("auto_family", """SELECT user_id::VARCHAR AS series_id, count(*) % 3 AS p, count(*) % 2 AS d, count(*) % 4 AS q,
CASE WHEN count(*) % 2 > 0 THEN 'ARIMA' WHEN count(*) % 3 > 0 AND count(*) % 4 > 0 THEN 'ARMA'
WHEN count(*) % 3 = 0 AND count(*) % 4 > 0 THEN 'MA' ELSE 'AR' END AS family FROM events GROUP BY 1""")
def auto_family(t):
    n = F.count("*")
    o = t("events").groupBy(F.col("user_id").cast("string").alias(SERIES)).agg((n % 3).alias("p"), (n % 2).alias("d"), (n % 4).alias("q"))
    return correlation.auto_family(o)


@query("ar_order_aic", USER + f""", l AS (SELECT *, lag(w, 1) OVER o AS l1, lag(w, 2) OVER o AS l2 FROM c WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
z AS (SELECT series_id, any_value(n) AS m, (sum(w * w) FILTER (idx >= 1) - pow(sum(w * l1), 2) / sum(l1 * l1)) / any_value(n) AS s1,
  sum(l1 * l1) FILTER (idx >= 2) AS a11, sum(l1 * l2) AS a12, sum(l2 * l2) AS a22, sum(w * l1) FILTER (idx >= 2) AS b1, sum(w * l2) AS b2,
  sum(w * w) FILTER (idx >= 2) AS yy FROM l GROUP BY 1),
k AS (SELECT series_id, 1 AS p, m * (ln(2 * pi() * s1) + 1) + 4 AS aic FROM z UNION ALL SELECT series_id, 2,
  m * (ln(2 * pi() * (yy - (b1 * (b1 * a22 - b2 * a12) + b2 * (a11 * b2 - a12 * b1)) / (a11 * a22 - a12 * a12)) / m) + 1) + 6 FROM z)
SELECT series_id, arg_min(p, aic)::BIGINT AS p, {r('min(aic)')} AS aic FROM k GROUP BY 1""")
def ar_order_aic(t):
    return estimation.ar_order_aic(t.ev_user(), 2)


ADF0 = """, ad AS (SELECT series_id, idx, n, y, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS l FROM s),
ar AS (SELECT series_id, count(*) AS m, regr_slope(y - l, l) AS b, regr_sxx(y - l, l) AS sxx, regr_syy(y - l, l) AS syy FROM ad WHERE idx >= 1 GROUP BY 1),
adf AS (SELECT series_id, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS stat FROM ar)
"""
LEVEL = "CASE WHEN stat < -3.43 THEN '1%' WHEN stat < -2.86 THEN '5%' WHEN stat < -2.57 THEN '10%' ELSE 'none' END"


@query("adf_test", USER + ADF0 + f"SELECT series_id, {r('stat')} AS adf_stat, {LEVEL} AS adf_level, stat < -2.86 AS adf_stationary FROM adf")
def adf_test(t):
    return stationarity.adf_test(t.ev_user(), max_lags=0).drop("adf_lags")


@query("adf_lag_select")
def adf_lag_select(t):
    return stationarity.adf_lag_select(t.ev_user())


# Bartlett weights need one autocovariance per lag; rho * c0 gives them.
def lrv_sql(base: str, lags: int = 12) -> str:
    return rho_sql(lags, base) + """, lw AS (SELECT series_id, n, least(floor(4 * pow(n / 100.0, 2.0 / 9)), n // 4) AS depth FROM v),
lr AS (SELECT rho.series_id, any_value(v.n) AS n, greatest(1e-10, any_value(c0) / any_value(v.n) * (1 + 2 * coalesce(sum(CASE WHEN lag BETWEEN 1 AND depth
  THEN (1 - lag / (depth + 1)) * r END), 0))) AS lrv FROM rho JOIN v USING (series_id) JOIN lw USING (series_id) GROUP BY 1)
"""


@query("long_run_variance", lrv_sql(USER) + f"SELECT series_id, n, {r('lrv')} AS lrv FROM lr")
def long_run_variance(t):
    return stationarity.long_run_variance(stationarity._residuals(t.ev_user(), "c", (SERIES,), False), "_e")


KPSS = lrv_sql(USER) + """, cs AS (SELECT series_id, sum(w) OVER (PARTITION BY series_id ORDER BY idx) AS cum FROM c),
kp AS (SELECT cs.series_id, sum(cum * cum) / (any_value(n) * any_value(n) * any_value(lrv)) AS k FROM cs JOIN lr USING (series_id) GROUP BY 1)
"""
KPSS_P = "CASE WHEN k < 0.347 THEN 0.1 WHEN k < 0.463 THEN 0.05 WHEN k < 0.739 THEN 0.01 ELSE 0.001 END::DOUBLE"


@query("kpss_test", KPSS + f"SELECT series_id, {r('k')} AS kpss_stat, {KPSS_P} AS kpss_p, k < 0.463 AS kpss_stationary FROM kp")
def kpss_test(t):
    return stationarity.kpss_test(t.ev_user())


@query("stationarity", KPSS + ADF0 + f"""SELECT series_id, {r('stat')} AS adf_stat, {r('k')} AS kpss_stat,
stat < -2.86 AND k < 0.463 AS is_stationary FROM adf JOIN kp USING (series_id)""")
def stationarity_both(t):
    return stationarity.stationarity(t.ev_user(), max_lags=0).select(SERIES, "adf_stat", "kpss_stat", "is_stationary")


@query("choose_d")
def choose_d(t):
    return stationarity.choose_d(t.ev_user())


_ONCE = USER.replace("c AS (SELECT *, y - avg(y)", "d AS (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS y, idx - 1 AS idx, n - 1 AS n FROM s QUALIFY idx >= 0),\nc AS (SELECT *, y - avg(y)").replace("AS mean FROM s)", "AS mean FROM d)")
_BOTH = KPSS + ADF0 + "SELECT series_id, stat < -2.86 AND k < 0.463 AS ok FROM adf JOIN kp USING (series_id)"


@query("choose_d_without_lags", f"""SELECT series_id, CASE WHEN a.ok THEN 0 WHEN b.ok THEN 1 ELSE 2 END::BIGINT AS d
FROM ({_BOTH}) a JOIN ({_BOTH.replace(USER, _ONCE)}) b USING (series_id)""")
def choose_d_without_lags(t):
    """ADF without lags, so that SQL can follow; walks of the values need a difference."""
    walks = t.ev_user()
    return stationarity.choose_d(walks, 2, max_lags=0)


ROOTS = rho_sql(2, USER) + """, k AS (SELECT series_id, 3 * max(r) FILTER (lag = 1) AS a, 3 * max(r) FILTER (lag = 2) AS b FROM rho GROUP BY 1)
"""


def _wild_pairs(t):
    """Two coefficients per user, three times the first correlations: some of them unstable."""
    a = correlation.acf(t.ev_user(), 2)
    return a.select(SERIES, F.transform(F.slice("acf", 2, 2), lambda v: v * 3).alias("coefs"))


@query("check_stationary_roots", ROOTS + "SELECT series_id, abs(b) < 1 AND b + a < 1 AND b - a < 1 AS is_stationary FROM k")
def check_stationary_roots(t):
    return stationarity.check_stationary_roots(_wild_pairs(t), "coefs").select(SERIES, "is_stationary")


@query("check_invertible_roots", ROOTS + "SELECT series_id, abs(b) < 1 AND -b - a < 1 AND a - b < 1 AS is_invertible FROM k")
def check_invertible_roots(t):
    return stationarity.check_invertible_roots(_wild_pairs(t), "coefs").select(SERIES, "is_invertible")
