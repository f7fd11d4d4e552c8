"""Joins, vectors, matrices, selection over fit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.operators import estimation, linalg, selection, shaping
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import COO, DAILY, HOURLY, REVENUE, USER

B = dict(bounded=True)


def quantity(t):
    """Monthly shipped quantity next to the monthly revenue series."""
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    both = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias(SERIES), month.alias(TIME)).agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000.0).alias("x"),
        F.sum("l_quantity").alias("q"))
    return both


PAIR = """WITH base AS (SELECT l_returnflag || l_linestatus AS series_id, date_trunc('month', l_shipdate) AS t,
sum(l_extendedprice * (1 - l_discount)) / 1000.0 AS x, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM base)
"""


@query("dot_product", PAIR + f"SELECT series_id, {r('sum(x * q) / 1e6')} AS dot FROM s GROUP BY 1")
def dot_product(t):
    s = layout.with_index(quantity(t), bounded=True)
    a, b = s.withColumn(VALUE, F.col("x")), s.withColumn(VALUE, F.col("q"))
    return linalg.dot_product(a, b).withColumn("dot", F.col("dot") / 1e6)


@query("matvec", COO + f""", v AS (SELECT col AS idx, avg(value) AS y FROM m GROUP BY 1)
SELECT row, {r('sum(value * y)')} AS value FROM m JOIN v ON m.col = v.idx GROUP BY 1""")
def matvec(t):
    m = t.matrix()
    centre = m.groupBy(F.col("col").alias(IDX)).agg(F.avg("value").alias(VALUE))
    return linalg.matvec(m, centre)


@query("matmul", COO + f"""SELECT a.col AS row, b.col AS col, {r('sum(a.value * b.value)')} AS value
FROM m a JOIN m b ON a.row = b.row GROUP BY 1, 2""")
def matmul(t):
    """X'X of the embeddings: a 64 x 64 result from all vectors."""
    m = t.matrix()
    return linalg.matmul(m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), m)


@query("lag_join", REVENUE + f"""SELECT a.series_id, a.idx, {r('a.y', 8)} AS y, {r('b.y', 8)} AS y_lag FROM s a JOIN s b
ON a.series_id = b.series_id AND a.idx = b.idx + 7""", 8)
def lag_join(t):
    return linalg.lag_join(t.revenue(), 7)


def _ccf_sql(lags: int) -> str:
    parts = []
    for k in range(-lags, lags + 1):
        parts.append(f"""SELECT a.series_id, {k}::BIGINT AS lag, {r('coalesce(avg(a.cx * b.cq) / nullif(any_value(a.sx) * any_value(a.sq), 0), 0)')} AS ccf
FROM z a JOIN z b ON a.series_id = b.series_id AND b.idx = a.idx - ({k}) GROUP BY 1""")
    return PAIR + """, z AS (SELECT series_id, idx, x - avg(x) OVER p AS cx, q - avg(q) OVER p AS cq, stddev_pop(x) OVER p AS sx,
stddev_pop(q) OVER p AS sq FROM s WINDOW p AS (PARTITION BY series_id))
""" + " UNION ALL ".join(parts)


@query("cross_correlation", _ccf_sql(6))
def cross_correlation(t):
    return linalg.cross_correlation(quantity(t), "x", "q", 6, **B)


@query("seasonal_join", HOURLY + f"""SELECT series_id, idx, idx % 24 AS phase, {r('y')} AS y,
{r('avg(y) OVER (PARTITION BY series_id, idx % 24)')} AS seasonal FROM s""")
def seasonal_join(t):
    return linalg.seasonal_join(t.hourly(), 24).select(SERIES, IDX, "phase", VALUE, "seasonal")


GRID = estimation.grid_orders(2, 2, (0, 1))


@query("task_grid", "WITH w AS (SELECT DISTINCT user_id::VARCHAR AS series_id FROM events), o AS (SELECT * FROM (VALUES "
       + ", ".join(str(o) for o in GRID) + ") o(p, d, q)) SELECT series_id, p::BIGINT AS p, d::BIGINT AS d, q::BIGINT AS q FROM w, o")
def task_grid(t):
    return linalg.task_grid(t.ev_user().select(SERIES).distinct(), GRID)


def naive_pairs(t, lag: int):
    """One-step forecasts of the daily series: the value ``lag`` positions earlier."""
    p = linalg.lag_join(t.daily(), lag)
    return p.select(SERIES, F.col(IDX).alias("step"), F.col(VALUE).alias("actual"), F.col("y_lag").alias("forecast"))


NAIVE = DAILY + """, f1 AS (SELECT a.series_id, a.idx AS step, a.y AS actual, b.y AS forecast FROM s a JOIN s b
 ON a.series_id = b.series_id AND a.idx = b.idx + 1),
f7 AS (SELECT a.series_id, a.idx AS step, a.y AS actual, b.y AS forecast FROM s a JOIN s b
 ON a.series_id = b.series_id AND a.idx = b.idx + 7),
pairs AS (SELECT series_id, step, f1.forecast AS forecast_a, f7.forecast AS forecast_b FROM f1 JOIN f7 USING (series_id, step)),
e AS (SELECT series_id, step, actual, forecast AS predicted FROM f1)
"""


def forecast_pairs(t):
    return linalg.align_forecasts(naive_pairs(t, 1), naive_pairs(t, 7))


@query("align_forecasts", NAIVE + f"SELECT series_id, step, {r('forecast_a')} AS forecast_a, {r('forecast_b')} AS forecast_b FROM pairs")
def align_forecasts(t):
    return forecast_pairs(t)


@query("align_actual", NAIVE + f"SELECT series_id, step, {r('actual')} AS actual, {r('predicted')} AS predicted FROM e")
def align_actual(t):
    f = naive_pairs(t, 1)
    return linalg.align_actual(f.select(SERIES, "step", "actual"), f)


@query("sum_squares", USER + f"SELECT series_id, {r('sum(y * y)', 4)} AS sum_squares FROM s GROUP BY 1", 4)
def sum_squares(t):
    return linalg.sum_squares(t.ev_user())


@query("vector_mean", USER + f"SELECT series_id, {r('avg(y)')} AS mean FROM s GROUP BY 1")
def vector_mean(t):
    return linalg.vector_mean(t.ev_user())


@query("vector_variance", USER + f"SELECT series_id, {r('var_pop(y)')} AS variance, {r('avg((y - 50) * (y - 50))')} AS around_50 FROM s GROUP BY 1")
def vector_variance(t):
    s = t.ev_user()
    return linalg.vector_variance(s).join(
        linalg.vector_variance(s, 50.0).withColumnRenamed("variance", "around_50"), SERIES)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(source: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({names[a]}, {names[b]})')} AS corr FROM {source}"
        for a in NUMBERS for b in NUMBERS)


@query("correlation_matrix", _corr_sql("lineitem", {c: c for c in NUMBERS}))
def correlation_matrix(t):
    return linalg.correlation_matrix(t("lineitem"), NUMBERS)


GAPPY = ("(SELECT l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS l_extendedprice, "
         "CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)")


def gappy(t):
    number = F.col("l_linenumber")
    return t("lineitem").withColumns({"l_extendedprice": F.when(number % 3 != 0, F.col("l_extendedprice")),
                                      "l_discount": F.when(number % 2 == 0, F.col("l_discount"))})


@query("correlation_matrix_missing", _corr_sql(GAPPY, {c: c for c in NUMBERS}))
def correlation_matrix_missing(t):
    """Each pair over the rows that have both values."""
    return linalg.correlation_matrix(gappy(t), NUMBERS)


@query("correlation_matrix_spearman_missing", "WITH k AS (SELECT " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in NUMBERS)
       + f" FROM {GAPPY}) " + _corr_sql("k", {c: c for c in NUMBERS}))
def correlation_matrix_spearman_missing(t):
    return linalg.correlation_matrix(gappy(t), NUMBERS, "spearman")


@query("correlation_matrix_spearman", "WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMBERS)
       + " FROM lineitem) " + _corr_sql("k", {c: c for c in NUMBERS}))
def correlation_matrix_spearman(t):
    return linalg.correlation_matrix(t("lineitem"), NUMBERS, "spearman")


# ------------------------------------------------------------ fit tables both engines can compute

def window_fits(t):
    """AR(1) and AR(2) against the mean alone, per user and third of the user's series."""
    s = t.ev_user()
    w = shaping.assign_sliding(s, 3, 0.3)
    by = (SERIES, "window_id")
    ones = estimation.ar_fit(w, [1, 2], by=by, min_obs=10)
    zero = w.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(VALUE).alias("s2"))
    ll = -F.col("n") / 2.0 * (F.log(2.0 * F.pi() * F.col("s2")) + 1.0)
    zero = zero.select(*by, F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("q"),
                       (F.col("n") >= 10).alias("success"), (2.0 - 2.0 * ll).alias("aic"),
                       (2.0 - 2.0 * ll + 4.0 / (F.col("n") - 2)).alias("aicc"))
    return ones.select(*zero.columns).unionByName(zero)


GEOMETRY = USER + """, g AS (SELECT DISTINCT series_id, n, least(n, greatest(greatest(1, least(floor(n / (3 * 0.7 + 0.3)), n)),
  least(n, greatest(10, floor(n / 8)))))::BIGINT AS size FROM s),
gg AS (SELECT *, greatest(1, floor(size * 0.7))::BIGINT AS step FROM g),
gc AS (SELECT *, least(3, floor((n - size) / step)::BIGINT + 1) AS windows FROM gg),
gw AS (SELECT series_id, n, size, step, windows, unnest(range(0, windows)) AS window_id FROM gc),
w AS (SELECT *, CASE WHEN window_id = windows - 1 THEN n ELSE window_id * step + size END AS stop FROM gw),
x AS (SELECT s.series_id, window_id, idx - window_id * step AS i, y FROM s JOIN w ON s.series_id = w.series_id
  AND idx >= window_id * step AND idx < stop)
"""

FITS = GEOMETRY + """, cx AS (SELECT *, y - avg(y) OVER k AS c, count(*) OVER k AS m FROM x WINDOW k AS (PARTITION BY series_id, window_id)),
lx AS (SELECT *, lag(c, 1) OVER o AS l1, lag(c, 2) OVER o AS l2 FROM cx WINDOW o AS (PARTITION BY series_id, window_id ORDER BY i)),
z AS (SELECT series_id, window_id, any_value(m) AS m, sum(c * c) / any_value(m) AS s0,
  (sum(c * c) FILTER (i >= 1) - pow(sum(c * l1) FILTER (i >= 1), 2) / sum(l1 * l1) FILTER (i >= 1)) / any_value(m) AS s1,
  sum(l1 * l1) FILTER (i >= 2) AS a11, sum(l1 * l2) FILTER (i >= 2) AS a12, sum(l2 * l2) FILTER (i >= 2) AS a22,
  sum(c * l1) FILTER (i >= 2) AS b1, sum(c * l2) FILTER (i >= 2) AS b2, sum(c * c) FILTER (i >= 2) AS yy FROM lx GROUP BY 1, 2),
z2 AS (SELECT *, (yy - (b1 * (b1 * a22 - b2 * a12) + b2 * (a11 * b2 - a12 * b1)) / (a11 * a22 - a12 * a12)) / m AS s2 FROM z),
u AS (SELECT series_id, window_id, m, 0 AS p, s0 AS v FROM z2 UNION ALL SELECT series_id, window_id, m, 1, s1 FROM z2
  UNION ALL SELECT series_id, window_id, m, 2, s2 FROM z2),
fits AS (SELECT series_id, window_id, m, p::BIGINT AS p, 0::BIGINT AS d, 0::BIGINT AS q, m >= 10 AS success,
  2 * (p + 1) + m * (ln(2 * pi() * v) + 1) AS aic,
  2 * (p + 1) + m * (ln(2 * pi() * v) + 1) + 2.0 * (p + 1) * (p + 2) / (m - p - 2) AS aicc FROM u),
ranks AS (SELECT *, rank() OVER (PARTITION BY series_id, window_id ORDER BY aicc) AS rank FROM fits WHERE success),
scores AS (SELECT series_id, p, d, q, avg(rank) AS rank_mean, stddev_samp(rank) AS rank_std, count(*) AS count,
  avg(aicc) AS aicc_mean, stddev_samp(aicc) AS aicc_std, avg(rank) + 0.5 * coalesce(stddev_samp(rank), 0) AS score
  FROM ranks GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9), p, d, q) AS pos FROM scores)),
nw AS (SELECT series_id, count(DISTINCT window_id) AS num_windows FROM fits GROUP BY 1)
"""
SCORE_COLUMNS = (f"series_id, p, d, q, {r('rank_mean')} AS rank_mean, {r('rank_std')} AS rank_std, count, "
                 f"{r('aicc_mean')} AS aicc_mean, {r('aicc_std')} AS aicc_std, {r('score')} AS score")


@query("rank_in_window", FITS + f"SELECT series_id, window_id, p, d, q, {r('aicc')} AS aicc, rank FROM ranks")
def rank_in_window(t):
    return selection.rank_in_window(window_fits(t)).select(SERIES, "window_id", "p", "d", "q", "aicc", "rank")


@query("score_orders", FITS + f"SELECT {SCORE_COLUMNS} FROM scores")
def score_orders(t):
    return selection.score_orders(window_fits(t))


@query("pick_best", FITS + f"SELECT {SCORE_COLUMNS} FROM best WHERE pos = 1")
def pick_best(t):
    return selection.pick_best(selection.score_orders(window_fits(t)))


@query("selection_confidence", FITS + f"""SELECT b.series_id, p, d, q, num_windows,
{r('0.6 * count / num_windows + 0.4 * CASE WHEN rank_std > 0 THEN 1 / (1 + rank_std) ELSE 1 END')} AS confidence
FROM best b JOIN nw USING (series_id) WHERE pos = 1""")
def selection_confidence(t):
    return selection.selection_confidence(window_fits(t)).select(SERIES, "p", "d", "q", "num_windows", "confidence")


@query("top_k_orders", FITS + f"SELECT series_id, p, d, q, {r('score')} AS score, pos AS position FROM best WHERE pos <= 2")
def top_k_orders(t):
    top = selection.top_k_orders(selection.score_orders(window_fits(t)), 2)
    return top.select(SERIES, "p", "d", "q", "score", "position")


@query("distinct_windows", FITS + "SELECT * FROM nw")
def distinct_windows(t):
    return selection.distinct_windows(window_fits(t))


@query("distinct_messages", """WITH f AS (SELECT event_type AS series_id, user_id::VARCHAR AS m, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY o, m) AS position, m AS message FROM f""")
def distinct_messages(t):
    e = t("events").select(F.col("event_type").alias(SERIES), F.col("user_id").cast("string").alias("message"), "event_id")
    return selection.distinct_messages(e, "message", "event_id")


@query("order_groups", USER + f"SELECT series_id, t, {r('y')} AS y FROM s ORDER BY 1, 2")
def order_groups(t):
    return selection.order_groups(t.ev_user().select(SERIES, TIME, VALUE))


@query("rank_models", NAIVE + f""", m AS (SELECT series_id, 'last value' AS model, f1.step, f1.actual - f1.forecast AS e FROM f1
UNION ALL SELECT series_id, 'last week', step, actual - forecast FROM f7),
k AS (SELECT series_id, model, count(*) AS n, sqrt(avg(e * e)) AS rmse,
 count(*) * ln(avg(e * e)) + CASE WHEN model = 'last value' THEN 2 ELSE 14 END AS aic,
 count(*) * ln(avg(e * e)) + CASE WHEN model = 'last value' THEN 1 ELSE 7 END * ln(count(*)) AS bic FROM m GROUP BY 1, 2)
SELECT series_id, model, {r('rmse')} AS rmse, {r('aic')} AS aic, {r('bic')} AS bic,
row_number() OVER (PARTITION BY series_id ORDER BY aic, model) AS aic_rank,
row_number() OVER (PARTITION BY series_id ORDER BY bic, model) AS bic_rank,
row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS rmse_rank,
row_number() OVER (PARTITION BY series_id ORDER BY aic, model) = 1 AS best FROM k""")
def rank_models(t):
    def scored(lag, name, k):
        e = F.col("actual") - F.col("forecast")
        g = naive_pairs(t, lag).groupBy(SERIES).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"))
        base = F.col("n") * F.log("mse")
        return g.select(SERIES, F.lit(name).alias("model"), F.sqrt("mse").alias("rmse"), (base + 2.0 * k).alias("aic"),
                        (base + k * F.log("n")).alias("bic"))
    return selection.rank_models(scored(1, "last value", 1).unionByName(scored(7, "last week", 7)))
