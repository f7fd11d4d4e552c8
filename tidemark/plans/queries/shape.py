"""Window functions, shaping, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.operators import shaping, transforms
from tidemark.plans.queries.algebra import GEOMETRY
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import DAILY, HOURLY, USER, positions


@query("with_index", USER + f"SELECT series_id, t, idx, {r('y')} AS y FROM s")
def with_index(t):
    return t.ev_user().select(SERIES, TIME, IDX, VALUE)


def _rolling_sql(function: str, name: str) -> str:
    return USER + (f"SELECT series_id, idx, {r(f'{function}(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')}"
                   f" AS {name} FROM s")


@query("rolling_mean", _rolling_sql("avg", "rolling_mean"))
def rolling_mean(t):
    return shaping.rolling_mean(t.ev_user(), 7).select(SERIES, IDX, "rolling_mean")


@query("rolling_std", _rolling_sql("stddev_samp", "rolling_std"))
def rolling_std(t):
    return shaping.rolling_std(t.ev_user(), 7).select(SERIES, IDX, "rolling_std")


@query("rolling_var", _rolling_sql("var_samp", "rolling_var"))
def rolling_var(t):
    return shaping.rolling_var(t.ev_user(), 7).select(SERIES, IDX, "rolling_var")


DIFF2 = DAILY + """, d2 AS (SELECT series_id, idx - 2 AS idx, y - 2 * lag(y, 1) OVER o + lag(y, 2) OVER o AS v, idx AS place FROM s
WINDOW o AS (PARTITION BY series_id ORDER BY idx))
"""


@query("difference", DIFF2 + f"SELECT series_id, idx, {r('v')} AS y FROM d2 WHERE place >= 2")
def difference(t):
    return positions(shaping.difference(t.daily(), 2))


@query("undifference", DAILY + f"""SELECT series_id, idx - 1 AS idx, {r('y - first_value(y) OVER (PARTITION BY series_id ORDER BY idx) + last_value(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 5)} AS y
FROM s QUALIFY idx >= 1""", 5)
def undifference(t):
    """The differences of a series, cumulated from its last observed value."""
    s = t.daily()
    return positions(shaping.undifference(shaping.difference(s, 1), shaping.last_levels(s, 1), 1))


@query("diff_transform", DAILY + f"SELECT series_id, idx - 2 AS idx, {r('y')} AS y FROM s WHERE idx >= 2")
def diff_transform(t):
    """Difference twice and back."""
    rows, state = transforms.diff_transform(t.daily(), 2)
    return positions(transforms.inverse_diff(rows, state, 2))


@query("lag_features", USER + f"SELECT series_id, idx, {r('y')} AS y, " + ", ".join(
    f"{r(f'lag(y, {k}) OVER (PARTITION BY series_id ORDER BY idx)')} AS lag_{k}" for k in (1, 2, 3)) + " FROM s")
def lag_features(t):
    return shaping.lag_features(t.ev_user(), 3).select(SERIES, IDX, VALUE, "lag_1", "lag_2", "lag_3")


@query("half_variance_ratio", USER + f"""SELECT series_id, {r('v2 / v1')} AS variance_ratio, v2 / v1 > 1.5 AS needs_log FROM (SELECT series_id,
var_pop(y) FILTER (idx < n // 2) AS v1, var_pop(y) FILTER (idx >= n // 2) AS v2 FROM s GROUP BY 1)""")
def half_variance_ratio(t):
    return shaping.half_variance_ratio(t.ev_user())


@query("window_plan", """WITH k AS (SELECT event_type AS series_id, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT user_id::VARCHAR, count(*) FROM events GROUP BY 1)
SELECT series_id, n, CASE WHEN n < 500 THEN 3 ELSE 5 END::BIGINT AS max_p, CASE WHEN n < 500 THEN 3 ELSE 5 END::BIGINT AS max_q,
CASE WHEN n < 500 THEN greatest(3, least(5, n // 100)) WHEN n < 2000 THEN greatest(5, least(10, n // 150))
 ELSE greatest(10, least(20, n // 150)) END AS num_sliding,
CASE WHEN n < 500 THEN greatest(3, n // 150) WHEN n < 2000 THEN greatest(4, n // 200) ELSE greatest(5, n // 250) END AS num_fixed,
CASE WHEN n < 500 THEN 0.3 WHEN n < 2000 THEN 0.2 ELSE 0.15 END::DOUBLE AS overlap FROM k""")
def window_plan(t):
    e = t("events")
    both = e.select(F.col("event_type").alias(SERIES)).unionByName(e.select(F.col("user_id").cast("string").alias(SERIES)))
    return shaping.plan_windows(both)


@query("sliding_windows", GEOMETRY + "SELECT series_id, window_id, window_id * step AS start_idx, stop AS end_idx FROM w")
def sliding_windows(t):
    return shaping.sliding_windows(t.ev_user(), 3, 0.3)


@query("assign_sliding", GEOMETRY + f"SELECT series_id, window_id, i AS idx, {r('y')} AS y FROM x")
def assign_sliding(t):
    return shaping.assign_sliding(t.ev_user(), 3, 0.3).select(SERIES, "window_id", IDX, VALUE)


@query("fixed_windows", DAILY + f""", z AS (SELECT *, greatest(n // 7, floor(12 / 0.7)::BIGINT + 10) AS size FROM s),
zw AS (SELECT *, least(7, n // size + CASE WHEN n % size >= floor(12 / 0.7)::BIGINT + 10 THEN 1 ELSE 0 END) AS windows FROM z),
f AS (SELECT *, least(idx // size, windows - 1) AS window_id FROM zw WHERE windows > 0),
fl AS (SELECT *, CASE WHEN window_id = windows - 1 THEN n - window_id * size ELSE size END AS len FROM f),
k AS (SELECT *, floor(len * 0.7::DOUBLE)::BIGINT AS train_size FROM fl)
SELECT series_id, window_id, idx - window_id * size AS idx, {r('y')} AS y, train_size,
CASE WHEN idx - window_id * size < train_size THEN 'train' ELSE 'test' END AS role FROM k WHERE train_size >= 12""")
def fixed_windows(t):
    w = shaping.fixed_windows(t.daily(), 2, 1, 7)
    return w.select(SERIES, "window_id", IDX, VALUE, "train_size", "role")


@query("consecutive_failures", DAILY + """, w AS (SELECT series_id, idx // 20 AS window_id, avg(y) > 430 AS overall_pass FROM s GROUP BY 1, 2),
f AS (SELECT *, window_id - lag(window_id) OVER (PARTITION BY series_id ORDER BY window_id) AS gap FROM w WHERE NOT overall_pass)
SELECT series_id, count(*) AS failed_windows, coalesce(bool_or(gap = 1), false) AS needs_adjustment FROM f GROUP BY 1""")
def consecutive_failures(t):
    """Windows of twenty days count as failed where their mean is low."""
    w = t.daily().groupBy(SERIES, F.expr(f"{IDX} div 20").alias("window_id")).agg((F.avg(VALUE) > 430).alias("overall_pass"))
    return shaping.consecutive_failures(w)


SEASONAL = HOURLY + """, tr AS (SELECT *, avg(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM s)
"""


@query("seasonal_decompose", SEASONAL + f""", a AS (SELECT *, avg(y - trend) OVER (PARTITION BY series_id, idx % 24) AS sa,
avg(y / trend) OVER (PARTITION BY series_id, idx % 24) AS sm FROM tr)
SELECT 'additive' AS model, series_id, idx, {r('trend')} AS trend, {r('sa')} AS seasonal, {r('y - trend - sa')} AS residual FROM a
UNION ALL SELECT 'multiplicative', series_id, idx, {r('trend')}, {r('sm')}, {r('y / (trend * sm)')} FROM a""")
def seasonal_decompose(t):
    parts = [shaping.seasonal_decompose(t.hourly(), 24, m).select(
        F.lit(m).alias("model"), SERIES, IDX, "trend", "seasonal", "residual") for m in ("additive", "multiplicative")]
    return parts[0].unionByName(parts[1])


def _resample_sql(seconds: int, value: str) -> str:
    return f"""WITH o AS (SELECT event_type AS series_id, min(date_trunc('day', ts))::TIMESTAMP AS origin, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1),
b AS (SELECT e.event_type AS series_id, (epoch_us(e.ts) - epoch_us(origin)) // ({seconds} * 1000000::BIGINT) AS bin, avg(value) AS m, sum(value) AS su
 FROM events e JOIN o ON e.event_type = o.series_id GROUP BY 1, 2),
g AS (SELECT series_id, origin, unnest(range((epoch_us(lo) - epoch_us(origin)) // ({seconds} * 1000000::BIGINT), (epoch_us(hi) - epoch_us(origin)) // ({seconds} * 1000000::BIGINT) + 1)) AS bin FROM o)
SELECT g.series_id, origin + to_microseconds(g.bin * {seconds} * 1000000::BIGINT) AS t, {value} AS y FROM g LEFT JOIN b ON g.series_id = b.series_id AND g.bin = b.bin"""


def _events(t):
    return t("events").select(F.col("event_type").alias(SERIES), F.col("ts").alias(TIME), F.col("value").alias(VALUE))


@query("resample", _resample_sql(5 * 86400, r("m", 8)), 8)
def resample(t):
    return shaping.resample(_events(t), 5 * 86400)


@query("resample_sum", _resample_sql(900, r("coalesce(su, 0)")))
def resample_sum(t):
    return shaping.resample(_events(t), 900, "sum")


@query("resample_quarter", f"""SELECT o_orderpriority AS series_id, date_trunc('quarter', o_orderdate)::TIMESTAMP AS t,
{r('avg(o_totalprice) / 1000 + 1e-9')} AS y FROM orders GROUP BY 1, 2""")
def resample_quarter(t):
    o = t("orders").select(F.col("o_orderpriority").alias(SERIES), F.col("o_orderdate").alias(TIME),
                           (F.col("o_totalprice") / 1000).alias(VALUE))
    # means of prices in cents often lie on a rounding edge; both sides step off it
    return shaping.resample_calendar(o, "quarter").withColumn(VALUE, F.col(VALUE) + 1e-9)


@query("log_transform", USER + f""", k AS (SELECT series_id, min(y - 20) AS lo FROM s GROUP BY 1)
SELECT series_id, idx, {r('ln(y - 20 + CASE WHEN lo <= 0 THEN -lo + 1e-6 ELSE 0 END)')} AS y,
{r('CASE WHEN lo <= 0 THEN -lo + 1e-6 ELSE 0 END')} AS log_c, {r('y - 20')} AS restored FROM s JOIN k USING (series_id)""")
def log_transform(t):
    shifted = t.ev_user().withColumn(VALUE, F.col(VALUE) - 20)
    logged = transforms.log_transform(shifted)
    back = transforms.inverse_log(logged).withColumnRenamed(VALUE, "restored").select(SERIES, IDX, "restored")
    return logged.select(SERIES, IDX, VALUE, "log_c").join(back, [SERIES, IDX])


LAMBDA_ROWS = ", ".join(f"({round(-2 + 0.1 * i, 10)})" for i in range(41))
BOXCOX = DAILY + f""", grid AS (SELECT l::DOUBLE AS l FROM (VALUES {LAMBDA_ROWS}) v(l)),
ll AS (SELECT series_id, l, (l - 1) * sum(ln(y)) - count(*) / 2.0 * ln(var_pop(CASE WHEN abs(l) < 1e-12 THEN ln(y) ELSE (pow(y, l) - 1) / l END)) AS f
 FROM s, grid GROUP BY 1, 2),
b AS (SELECT series_id, arg_max(l, f) AS lam FROM ll GROUP BY 1)
"""


@query("boxcox_lambda", BOXCOX + f"SELECT series_id, {r('lam')} AS lam FROM b")
def boxcox_lambda(t):
    return transforms.boxcox_lambda(t.daily(), refine=False).withColumnRenamed("lambda", "lam")


FINE_ROWS = ", ".join(f"({round(-0.1 + 0.01 * i, 10)})" for i in range(21))


@query("boxcox_transform", BOXCOX + f""", fine AS (SELECT l::DOUBLE AS l FROM (VALUES {FINE_ROWS}) v(l)),
lf AS (SELECT s.series_id, lam + l AS l, (lam + l - 1) * sum(ln(y)) - count(*) / 2.0 * ln(var_pop(
 CASE WHEN abs(lam + l) < 1e-12 THEN ln(y) ELSE (pow(y, lam + l) - 1) / (lam + l) END)) AS f
 FROM s JOIN b USING (series_id), fine GROUP BY 1, 2),
bf AS (SELECT series_id, arg_max(l, f) AS lam FROM lf GROUP BY 1)
SELECT series_id, idx, {r('lam')} AS lam, {r('CASE WHEN abs(lam) < 1e-12 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END', 5)} AS y
FROM s JOIN bf USING (series_id)""", 5)
def boxcox_transform(t):
    return transforms.boxcox_transform(t.daily()).select(SERIES, IDX, F.col("lambda").alias("lam"), VALUE)


@query("standard_scale", USER + f"""SELECT series_id, idx, {r('(y - avg(y) OVER p) / stddev_pop(y) OVER p')} AS y, {r('y')} AS restored
FROM s WINDOW p AS (PARTITION BY series_id)""")
def standard_scale(t):
    z = transforms.standard_scale(t.ev_user())
    back = transforms.inverse_standard(z).withColumnRenamed(VALUE, "restored").select(SERIES, IDX, "restored")
    return positions(z).join(back, [SERIES, IDX])


@query("minmax_scale", USER + f"""SELECT series_id, idx, {r('(y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p) * 2 - 1')} AS y, {r('y')} AS restored
FROM s WINDOW p AS (PARTITION BY series_id)""")
def minmax_scale(t):
    z = transforms.minmax_scale(t.ev_user(), -1.0, 1.0)
    back = transforms.inverse_minmax(z, -1.0, 1.0).withColumnRenamed(VALUE, "restored").select(SERIES, IDX, "restored")
    return positions(z).join(back, [SERIES, IDX])
