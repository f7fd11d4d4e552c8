"""Cleaning and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.layout import IDX, SERIES, VALUE
from tidemark.operators import cleaning, linalg, quality
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import DAILY, DIRTY, MONTHLY, USER, positions

B = dict(bounded=True)


@query("drop_missing", DIRTY + f"SELECT series_id, t, {r('y')} AS y FROM s WHERE y IS NOT NULL")
def drop_missing(t):
    return cleaning.drop_missing(t.dirty())


@query("fill_drop", DIRTY + f"SELECT series_id, t, {r('y')} AS y FROM s WHERE y IS NOT NULL")
def fill_drop(t):
    return cleaning.fill_drop(t.dirty())


@query("require_min_length", """SELECT user_id::VARCHAR AS series_id, count(value) AS n,
CASE WHEN count(value) < 70 THEN 'series too short: ' || count(value) || ' < 70' ELSE 'ok' END AS status
FROM events GROUP BY 1""")
def require_min_length(t):
    return quality.require_min_length(t.ev_user(), 70)


GRID = [(1, 0, 0), (1, 1, 1), (5, 2, 45)]
GRID_SQL = "(VALUES (1,0,0), (1,1,1), (5,2,45)) o(p, d, q)"


@query("require_window_length", f"""WITH w AS (SELECT user_id::VARCHAR AS series_id, count(*) AS n FROM events GROUP BY 1)
SELECT series_id, n, p::BIGINT AS p, d::BIGINT AS d, q::BIGINT AS q, n >= greatest(p+d+q+10, 30) AS success,
CASE WHEN n < greatest(p+d+q+10, 30) THEN 'window too short: ' || n || ' < ' || greatest(p+d+q+10, 30) END AS error
FROM w, {GRID_SQL}""")
def require_window_length(t):
    w = t.ev_user().groupBy(SERIES).agg(F.count("*").alias("n"))
    return quality.require_window_length(linalg.task_grid(w, GRID))


@query("require_complete", DIRTY + """SELECT series_id, NOT bool_or(y IS NULL OR isnan(y) OR isinf(y)) AS complete
FROM s GROUP BY 1""")
def require_complete(t):
    return quality.require_complete(t.dirty())


STATS = ", ".join([f"{r('avg(y)')} AS mean", f"{r('stddev_pop(y)')} AS std", f"{r('min(y)')} AS min",
                   f"{r('max(y)')} AS max", f"{r('quantile_cont(y, 0.5)')} AS median"])
QUARTILES = f"{r('quantile_cont(y, 0.25)')} AS q25, {r('quantile_cont(y, 0.75)')} AS q75"


@query("series_info", USER + f"SELECT series_id, count(*) AS length, {STATS} FROM s GROUP BY 1")
def series_info(t):
    return quality.series_info(t.ev_user())


@query("basic_stats", DIRTY + f"SELECT series_id, count(*) AS length, {STATS}, {QUARTILES} FROM s GROUP BY 1")
def basic_stats(t):
    return quality.basic_stats(t.dirty())


@query("missing_report", DIRTY + f"""SELECT series_id, count(*) FILTER (y IS NULL) AS missing_count,
{r('avg((y IS NULL)::INT)')} AS missing_ratio, bool_or(y IS NULL) AS has_missing FROM s GROUP BY 1""")
def missing_report(t):
    return quality.missing_report(t.dirty())


@query("missing_positions", DIRTY + "SELECT series_id, idx FROM s WHERE y IS NULL")
def missing_positions(t):
    return quality.missing_positions(t.dirty())


@query("check_infinite", """SELECT user_id::VARCHAR AS series_id,
bool_or(coalesce(isinf(CASE WHEN value < 1 THEN 'inf'::DOUBLE ELSE value END), false)) AS has_infinite FROM events GROUP BY 1""")
def check_infinite(t):
    return quality.check_infinite(t.ev_user().withColumn(
        VALUE, F.when(F.col(VALUE) < 1, float("inf")).otherwise(F.col(VALUE))))


@query("check_constant", """SELECT o_custkey::VARCHAR AS series_id, min(o_totalprice) = max(o_totalprice) AS is_constant
FROM orders GROUP BY 1""")
def check_constant(t):
    o = t("orders").select(F.col("o_custkey").cast("string").alias(SERIES), F.col("o_totalprice").alias(VALUE))
    return quality.check_constant(o)


@query("outliers_iqr", USER + f"""SELECT s.series_id, idx, {r('y')} AS y FROM s JOIN (SELECT series_id,
quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b, count(*) AS k FROM s GROUP BY 1) q USING (series_id)
WHERE k >= 4 AND (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a))""")
def outliers_iqr(t):
    return quality.outliers_iqr(t.ev_user())


@query("outliers_zscore", USER + f"""SELECT s.series_id, idx, {r('y')} AS y, {r('(y - m) / sd')} AS z FROM s JOIN (SELECT
series_id, avg(y) AS m, stddev_pop(y) AS sd, count(*) AS k FROM s GROUP BY 1) q USING (series_id)
WHERE k >= 4 AND sd > 0 AND abs((y - m) / sd) > 3""")
def outliers_zscore(t):
    return quality.outliers_zscore(t.ev_user())


@query("outliers_modified_zscore", USER + f""", md AS (SELECT series_id, quantile_cont(y, 0.5) AS med FROM s GROUP BY 1),
mad AS (SELECT s.series_id, any_value(med) AS med, quantile_cont(abs(y - med), 0.5) AS mad FROM s JOIN md USING (series_id) GROUP BY 1)
SELECT s.series_id, idx, {r('y')} AS y, {r('0.6745 * (y - med) / mad')} AS z FROM s JOIN mad USING (series_id)
WHERE mad > 0 AND abs(0.6745 * (y - med) / mad) > 3.5""")
def outliers_modified_zscore(t):
    return quality.outliers_modified_zscore(t.ev_user())


def acf_sql(lag: int) -> str:
    return (f"sum(CASE WHEN idx >= {lag} THEN w * lw{lag} END) / sum(w * w)")


SEASON = """, l AS (SELECT series_id, idx, n, w, lag(w, 4) OVER o AS lw4, lag(w, 7) OVER o AS lw7, lag(w, 12) OVER o AS lw12,
lag(w, 24) OVER o AS lw24 FROM c WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
p AS (SELECT series_id, max(n) AS n, """ + ", ".join(f"{acf_sql(k)} AS r{k}" for k in (4, 7, 12, 24)) + """ FROM l GROUP BY 1),
f AS (SELECT series_id, list_filter([CASE WHEN n >= 12 AND abs(r4) > 0.3 THEN 4 END,
CASE WHEN n >= 28 AND abs(r7) > 0.3 THEN 7 END, CASE WHEN n >= 48 AND abs(r12) > 0.3 THEN 12 END,
CASE WHEN n >= 96 AND abs(r24) > 0.3 THEN 24 END], lambda x: x IS NOT NULL) AS k FROM p)
"""


@query("detect_seasonality", USER + SEASON.replace("n >= 12 AND abs(r4)", "n >= 16 AND abs(r4)") +
       "SELECT series_id, array_to_string(k, ',') AS seasonal_periods, len(k) > 0 AS has_seasonality FROM f")
def detect_seasonality(t):
    return quality.detect_seasonality(t.ev_user()).withColumn("seasonal_periods", F.array_join("seasonal_periods", ","))


@query("detect_trend", DAILY + f"""SELECT series_id, {r('regr_slope(y, idx)')} AS slope, {r('regr_r2(y, idx)')} AS r_squared,
regr_r2(y, idx) > 0.1 AS has_trend, CASE WHEN regr_slope(y, idx) > 0 THEN 'increasing'
WHEN regr_slope(y, idx) < 0 THEN 'decreasing' ELSE 'none' END AS trend_direction FROM s GROUP BY 1""")
def detect_trend(t):
    return quality.detect_trend(t.daily(), **B)


VALID = DIRTY + f""", pres AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx
  FROM s WHERE y IS NOT NULL),
q AS (SELECT series_id, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b, count(*) AS k,
  coalesce(regr_r2(y, idx) > 0.1, false) AS has_trend FROM pres GROUP BY 1),
o AS (SELECT p.series_id, count(*) AS outlier_count FROM pres p JOIN q USING (series_id)
  WHERE k >= 4 AND (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a)) GROUP BY 1),
g AS (SELECT series_id, count(*) AS length, count(*) FILTER (y IS NULL) AS miss, avg((y IS NULL)::INT) AS ratio,
  avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, quantile_cont(y, 0.5) AS median FROM s GROUP BY 1),
v AS (SELECT g.*, coalesce(outlier_count, 0) AS outlier_count, has_trend, k,
  CASE WHEN ratio > 0.1 THEN 'Too many missing values: ' || format('{{:.2f}}%', ratio * 100) || ' > 10.00%' ELSE '' END AS issues,
  concat_ws('; ', CASE WHEN ratio > 0 AND ratio <= 0.1 THEN 'Missing values detected: ' || format('{{:.2f}}%', ratio * 100) END,
   CASE WHEN outlier_count > 0 THEN 'Outliers detected: ' || outlier_count || ' (' || format('{{:.2f}}%', outlier_count * 100.0 / k) || ')' END) AS warnings
  FROM g JOIN q USING (series_id) LEFT JOIN o USING (series_id))
"""


@query("validate_series", VALID + f"""SELECT series_id, length, {r('mean')} AS mean, outlier_count, has_trend,
issues = '' AS is_valid, issues, warnings FROM v""")
def validate_series(t):
    v = quality.validate_series(t.dirty(), **B)
    return v.select(SERIES, "length", "mean", "outlier_count", "has_trend", "is_valid",
                    F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"))


@query("quality_report", VALID + """SELECT series_id, concat_ws(chr(10), 'Data Quality Report', 'Data Information:',
'  Length: ' || length, '  Mean: ' || format('{:.6f}', mean), '  Std: ' || format('{:.6f}', std),
'  Min: ' || format('{:.6f}', min), '  Max: ' || format('{:.6f}', max), '  Median: ' || format('{:.6f}', median),
CASE WHEN issues <> '' THEN 'Issues Found:' || chr(10) || '  - ' || issues END,
CASE WHEN warnings <> '' THEN 'Warnings:' || chr(10) || '  - ' || replace(warnings, '; ', chr(10) || '  - ') END,
'Overall Status: ' || CASE WHEN issues = '' THEN 'VALID' ELSE 'INVALID' END) AS report FROM v""")
def quality_report(t):
    return quality.quality_report(quality.validate_series(t.dirty(), **B))


CARRY = """, k AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, first_value(CASE WHEN y IS NOT NULL THEN idx END IGNORE NULLS) OVER
  (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni, first_value(y IGNORE NULLS) OVER
  (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM s)
"""


@query("fill_linear", DIRTY + CARRY + f"""SELECT series_id, idx, {r('coalesce(y, pv + (nv - pv) * (idx - pi) / nullif(ni - pi, 0), pv, nv)')} AS y
FROM k""")
def fill_linear(t):
    return positions(cleaning.fill_linear(t.dirty()))


@query("fill_forward", DIRTY + CARRY + f"SELECT series_id, idx, {r('pv')} AS y FROM k")
def fill_forward(t):
    return positions(cleaning.fill_forward(t.dirty()))


@query("fill_backward", DIRTY + CARRY + f"SELECT series_id, idx, {r('nv')} AS y FROM k")
def fill_backward(t):
    return positions(cleaning.fill_backward(t.dirty()))


@query("fill_nonfinite_median", DIRTY + f""", m AS (SELECT series_id, quantile_cont(y, 0.5) AS med FROM s GROUP BY 1)
SELECT series_id, idx, {r('coalesce(y, med)')} AS y FROM s JOIN m USING (series_id)""")
def fill_nonfinite_median(t):
    return positions(cleaning.fill_nonfinite_median(t.dirty()))


@query("train_test_split", USER + f"""SELECT series_id, idx, {r('y')} AS y,
CASE WHEN idx < n - greatest(1, round_even(n * 0.2, 0)) THEN 'train' ELSE 'test' END AS role FROM s""")
def train_test_split(t):
    return cleaning.train_test_split(t.ev_user(), 0.2).select(SERIES, IDX, VALUE, "role")


@query("explore_series", (MONTHLY + f""", l1 AS (SELECT series_id, idx, w, lag(w, 1) OVER (PARTITION BY series_id ORDER BY idx) AS l1,
 lag(w, 2) OVER (PARTITION BY series_id ORDER BY idx) AS l2 FROM c),
a AS (SELECT series_id, sum(w * l1) / sum(w * w) AS r1, sum(w * l2) / sum(w * w) AS r2 FROM l1 GROUP BY 1),
g AS (SELECT series_id, count(*) AS length, {STATS}, {QUARTILES} FROM s GROUP BY 1 HAVING count(*) >= 10)
SELECT g.*, {r('r1')} AS acf_1, {r('r2')} AS acf_2, {r('(r2 - r1 * r1) / (1 - r1 * r1)')} AS pacf_2,
 least(20, floor(length / 4)::BIGINT + 1) AS depth FROM g JOIN a USING (series_id)""").replace(", 6)", ", 8)"), 8)
def explore_series(t):
    e = quality.explore_series(t.monthly(), **B)
    return e.select("*", F.get("acf", F.lit(1)).alias("acf_1"), F.get("acf", F.lit(2)).alias("acf_2"),
                    F.get("pacf", F.lit(2)).alias("pacf_2"), F.size("acf").alias("depth")).drop("acf", "pacf")
