"""AR / MA / ARMA / ARIMA fits for all series, windows and orders in one job.

Pure autoregressions come from product sums and never gather a series.  Models with a moving-average
part are fitted by a grouped Arrow kernel where a group fits one task, and by repeated passes over
chunks (``long_fit``) where it does not.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions import criteria
from tidemark.functions.guards import div
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators import correlation, kernels, shaping, stationarity
from tidemark.operators.cleaning import drop_missing
from tidemark.operators.regression import product_sums, solve, square

_ARR = T.ArrayType(T.DoubleType())
FIT_FIELDS = [
    T.StructField("p", T.LongType()), T.StructField("d", T.LongType()), T.StructField("q", T.LongType()),
    T.StructField("success", T.BooleanType()), T.StructField("phi", _ARR), T.StructField("theta", _ARR),
    T.StructField("c", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("sigma2", T.DoubleType()), T.StructField("log_likelihood", T.DoubleType()),
    T.StructField("aic", T.DoubleType()), T.StructField("aicc", T.DoubleType()),
    T.StructField("bic", T.DoubleType()), T.StructField("se", _ARR), T.StructField("n_obs", T.LongType()),
    T.StructField("y_tail", _ARR), T.StructField("e_tail", _ARR), T.StructField("levels", _ARR),
    T.StructField("error", T.StringType())]
FIT_NAMES = [f.name for f in FIT_FIELDS]
WINDOW_RULE = None  # min_obs: max(p + d + q + 10, 30)
GROUP_MIN = 10


def fit_schema(source: DataFrame, by) -> T.StructType:
    return T.StructType([source.schema[c] for c in by] + FIT_FIELDS)


def minimum(p: int, d: int, q: int, min_obs) -> int:
    return max(p + d + q + 10, 30) if min_obs is None else min_obs


def _fit_groups(by, min_obs, constant):
    names = [*by, *FIT_NAMES]

    def fit(groups):
        rows = []
        for key, header, columns in groups:
            if header is None:
                continue
            y = np.zeros(0) if columns is None else columns[VALUE].astype(float)
            flat = [int(v) for v in header["orders"]]
            for p, d, q in zip(flat[::3], flat[1::3], flat[2::3]):
                row = kernels.fit_order(y, p, d, q, minimum(p, d, q, min_obs), constant)
                rows.append([*key, *[row[c] for c in FIT_NAMES]])
        return pd.DataFrame(rows, columns=names)

    return fit


def order_specs(df: DataFrame, orders, by=BY) -> DataFrame:
    """The same literal orders for every group of ``df``."""
    grid = F.array(*[F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip("pdq", o)]) for o in orders])
    return df.select(*by).distinct().withColumn("_o", F.explode(grid)).select(*by, "_o.p", "_o.d", "_o.q")


def fit_orders(df: DataFrame, orders, by=BY, min_obs=GROUP_MIN, bounded: bool = False, constant: bool = True) -> DataFrame:
    """One fit row per group and order.

    ``orders`` is a list of ``(p, d, q)`` or a table ``(by, p, d, q)``.  The values of a group are
    shipped once for all its orders.  Without ``constant`` the (differenced) values vary around zero: no mean is taken off.
    """
    s = layout.with_index(df, by, bounded=bounded)
    specs = orders if isinstance(orders, DataFrame) else order_specs(s, orders, by)
    specs = specs.select(*by, *[F.col(c).cast("long").alias(c) for c in "pdq"])

    def grouped(rows, wanted):
        listed = wanted.groupBy(*by).agg(F.flatten(F.array_sort(F.collect_list(F.array("p", "d", "q")))).alias("orders"))
        return layout.map_groups(rows.select(*by, IDX, VALUE), listed, by, _fit_groups(by, min_obs, constant), fit_schema(s, by))

    if not layout.has_chunks(s):
        return grouped(s, specs)
    from tidemark.operators.long_fit import fit_long
    limit = layout.whole_rows(s)
    sized = layout.with_totals(s, by, _n=F.count("*"))
    long_groups = s.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*by)
    short = grouped(sized.filter(F.col("_n") <= limit), specs.join(long_groups, [*by], "left_anti"))
    rows, asked = sized.filter(F.col("_n") > limit).drop("_n"), specs.join(long_groups, [*by], "left_semi")
    listed = None if isinstance(orders, DataFrame) else [o for o in orders if o[2] > 0]  # a list needs no job to find its bounds
    moving = fit_long(rows, asked.filter("q > 0") if listed is None else listed, by, min_obs, constant)
    return short.unionByName(_closed_form(rows, asked.filter("q = 0"), by, min_obs, constant)).unionByName(moving)


def _closed_form(rows: DataFrame, specs: DataFrame, by, min_obs, constant) -> DataFrame:
    """Pure autoregressions of long series: the same least squares as in one task, from sums of products."""
    out = rows.sparkSession.createDataFrame([], fit_schema(rows, by))
    for d, ps in sorted((r["d"], r["ps"]) for r in specs.groupBy("d").agg(F.collect_set("p").alias("ps")).collect()):
        wanted = specs.filter(F.col("d") == d).select(*by, "p")
        mine = layout.join_series(rows, wanted.select(*by).distinct(), by)
        out = out.unionByName(ar_fit(mine, sorted(ps), d, by, min_obs, constant=constant).join(wanted, [*by, "p"], "left_semi"))
    return out


# ---------------------------------------------------------------- autoregressions from product sums

def _ar_solver(top: int, min_obs):
    result = T.ArrayType(T.StructType(FIT_FIELDS))

    def solver(upper: pd.Series, head: pd.Series, tail: pd.Series, mean: pd.Series, n: pd.Series, d: pd.Series,
               orders: pd.Series, levels: pd.Series) -> pd.Series:
        out = []
        for u, h, t, m, size, diff, ps, lev in zip(upper, head, tail, mean, n, d, orders, levels):
            size, diff = int(size), int(diff)
            gram, h, t = square(u, top + 1), np.asarray(h, dtype=float), np.asarray(t, dtype=float)[::-1]
            fits = []
            for p in [int(v) for v in ps]:
                row = dict.fromkeys(FIT_NAMES)
                row.update(p=p, d=diff, q=0, success=False, aicc=math.inf, n_obs=size)
                need = minimum(p, diff, 0, min_obs)
                if size + diff < need or size <= p + 1:
                    row["error"] = f"series too short: {size + diff} < {need}"
                    fits.append(row)
                    continue
                keep = [*range(p), top]
                g = gram[np.ix_(keep, keep)]
                for i in range(p, len(h)):
                    x = np.concatenate([h[i - 1::-1][:p] if p and i else [], [h[i]]])
                    g = g + np.outer(x, x)
                phi, se, rss = solve(g, size)
                if rss <= 1e-24 * max(1.0, size * m * m) or rss <= 1e-13 * g[-1, -1]:
                    row["error"] = "no variation left to fit"
                    fits.append(row)
                    continue
                row.update(kernels.criteria(size, rss, p + 1, size), success=True, phi=phi.tolist(), theta=[],
                           mean=m, c=m * (1.0 - float(phi.sum())),
                           se=(se * math.sqrt(max(size - p, 1) / size)).tolist(),
                           y_tail=t[:max(p, 1)].tolist(), e_tail=[], levels=list(lev))
                fits.append(row)
            out.append(fits)
        return pd.Series(out)

    return F.pandas_udf(solver, result)


def ar_fit(df: DataFrame, orders=(1,), d: int = 0, by=BY, min_obs=GROUP_MIN, bounded: bool = False, constant: bool = True) -> DataFrame:
    """AR(p) for every p in ``orders`` by exact conditional least squares; without ``constant`` from uncentred products.

    One pass of lag products at the largest order serves all orders: the equations smaller orders have
    in addition come from the first few values, which travel with the sums.
    """
    top = max(max(orders), 1)
    whole = layout.with_index(df, by, bounded=bounded)
    s = shaping.difference(whole, d, by) if d else whole
    centre = F.avg(VALUE) if constant else F.max(F.lit(0.0))
    s = layout.with_totals(s, by, _n=F.count("*"), _m=centre).withColumn("_c", F.col(VALUE) - F.col("_m"))
    s = s.select(*layout.keys(s, by), IDX, "_n", "_m", "_c")
    rows = layout.with_lags(s, "_c", top, by)
    past = [F.coalesce(F.col(f"lag_{k}"), F.lit(0.0)) for k in range(1, top + 1)]
    used = {f"_x{i}": F.when(F.col(IDX) >= top, c).otherwise(0.0) for i, c in enumerate([*past, F.col("_c")])}
    at = F.struct(F.col(IDX).alias("i"), F.col("_c").alias("v"))
    gather = lambda inside: F.array_sort(F.collect_list(F.when(inside, at)))
    g = rows.withColumns(used).groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_m").alias("m"), product_sums(list(used)).alias("g"),
        gather(F.col(IDX) < top).alias("h"), gather(F.col(IDX) >= F.col("_n") - top).alias("t"))
    if d:
        g = g.join(shaping.last_levels(whole, d, by), [*by])
    else:
        g = g.withColumn("levels", F.array().cast("array<double>"))
    wanted = F.array(*[F.lit(int(p)) for p in orders])
    fits = _ar_solver(top, min_obs)("g", F.col("h.v"), F.col("t.v"), "m", "n", F.lit(d), wanted, "levels")
    return g.select(*by, F.explode(fits).alias("f")).select(*by, "f.*")


def ar_order_aic(df: DataFrame, max_order: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    return best_fit(ar_fit(df, range(1, max_order + 1), by=by, bounded=bounded), "aic", by).select(*by, *if_success("p", "aic"))


def best_fit(fits: DataFrame, criterion: str = "aic", by=BY) -> DataFrame:
    """Lowest criterion among the successful fits of each group, ties to the smallest order.

    A group without any success keeps its first failed row, so that no group is lost.
    """
    rest = [c for c in fits.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(F.when(F.col("success"), 0).otherwise(1), criterion, "p", "d", "q"))
    return fits.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def if_success(*columns: str) -> list:
    return [F.when(F.col("success"), F.col(c)).alias(c) for c in columns]


def failed(keys: DataFrame, error: str, by=BY, order=(None, None, None)) -> DataFrame:
    """Fit rows of groups that could not be fitted at all."""
    given = {**dict(zip("pdq", order)), "success": False, "aicc": math.inf, "error": error}
    return keys.select(*by, *[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in FIT_FIELDS])


def without_values(df: DataFrame, least: int = 1, by=BY) -> DataFrame:
    """Keys of the groups with fewer than ``least`` usable values."""
    usable = F.count_if(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    return df.groupBy(*by).agg(usable.alias("_n")).filter(F.col("_n") < least).select(*by)


def fit_one(df: DataFrame, order, by=BY, bounded: bool = False, constant: bool = True) -> DataFrame:
    """One order for every group of ``df``, missing values left out; a group without values gets a failure row."""
    s = layout.with_index(drop_missing(df), by, bounded=bounded)
    p, d, q = order
    fits = ar_fit(s, [p], d, by, constant=constant) if q == 0 else fit_orders(s, [order], by, constant=constant)
    # groups that differencing leaves empty have no rows in the closed form
    empty = without_values(df, d + 1 if q == 0 else 1, by)
    return fits.unionByName(failed(empty, "no values to fit", by, order))


# ---------------------------------------------------------------- named fits and order searches

def ma_fit(df: DataFrame, q: int = 1, by=BY, bounded: bool = False, constant: bool = True) -> DataFrame:
    return fit_orders(df, [(0, 0, q)], by, bounded=bounded, constant=constant)


def arma_fit(df: DataFrame, p: int = 1, q: int = 1, by=BY, bounded: bool = False, constant: bool = True) -> DataFrame:
    return fit_orders(df, [(p, 0, q)], by, bounded=bounded, constant=constant)


def arima_fit(df: DataFrame, p: int = 1, d: int = 1, q: int = 1, by=BY, bounded: bool = False, constant: bool = True) -> DataFrame:
    return fit_orders(df, [(p, d, q)], by, bounded=bounded, constant=constant)


def grid_orders(max_p: int, max_q: int, ds=(0,)) -> list[tuple[int, int, int]]:
    return [(p, d, q) for d in ds for p in range(max_p + 1) for q in range(max_q + 1) if p + q]


def ma_order_aic(df: DataFrame, max_order: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    fits = fit_orders(df, [(0, 0, q) for q in range(1, max_order + 1)], by, bounded=bounded)
    return best_fit(fits, "aic", by).select(*by, *if_success("q", "aic"))


def arma_order_grid(df: DataFrame, max_ar: int = 3, max_ma: int = 3, criterion: str = "aic", by=BY,
                    bounded: bool = False) -> DataFrame:
    return best_fit(fit_orders(df, grid_orders(max_ar, max_ma), by, bounded=bounded), criterion, by)


def verify_d(df: DataFrame, chosen: DataFrame, max_d: int = 2, criterion: str = "aic", by=BY,
             bounded: bool = False) -> DataFrame:
    """ARIMA(1, d, 1) at d and its neighbours; the lowest criterion keeps its d."""
    near = F.filter(F.array(F.col("d") - 1, F.col("d"), F.col("d") + 1), lambda v: (v >= 0) & (v <= max_d))
    specs = chosen.select(*by, F.explode(near).alias("d"), F.lit(1).alias("p"), F.lit(1).alias("q"))
    best = best_fit(fit_orders(df, specs, by, bounded=bounded), criterion, by).select(*by, F.when(F.col("success"), F.col("d")).alias("_d"))
    return chosen.join(best, [*by], "left").select(*by, F.coalesce("_d", "d").cast("long").alias("d"))


def arima_order_select(df: DataFrame, max_p: int = 2, max_q: int = 2, max_d: int = 2, criterion: str = "aic",
                       verify: bool = False, by=BY, bounded: bool = False) -> DataFrame:
    """d from the tests (verified by fits when asked), then the ARMA grid at that d."""
    s = layout.with_index(df, by, bounded=bounded)
    chosen = stationarity.choose_d(s, max_d, by=by)
    if verify:
        chosen = verify_d(s, chosen, max_d, criterion, by)
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, _, q in grid_orders(max_p, max_q)])
    specs = chosen.withColumn("_o", F.explode(grid)).select(*by, "_o.p", "d", "_o.q")
    return best_fit(fit_orders(s, specs, by), criterion, by)


def parallel_model_selection(df: DataFrame, max_p: int = 5, max_d: int = 2, max_q: int = 5, by=BY,
                             bounded: bool = False):
    """``(all fits with failures, best by AIC)``."""
    fits = fit_orders(df, grid_orders(max_p, max_q, range(max_d + 1)), by, bounded=bounded)
    return fits, best_fit(fits, "aic", by)


def fit_groups(df: DataFrame, order=(1, 1, 1), auto: bool = False, by=BY, bounded: bool = False) -> DataFrame:
    """One fit row per group; missing values dropped, time-ordered; ``auto`` picks the order per group."""
    if not auto:
        return fit_one(df, order, by, bounded)
    chosen = arima_order_select(layout.with_index(drop_missing(df), by, bounded=bounded), by=by)
    return chosen.unionByName(failed(without_values(df, by=by), "no values to fit", by))


def model_explore(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """ACF / PACF summary next to both stationarity tests."""
    s = layout.with_index(drop_missing(df), by, bounded=bounded)
    return correlation.acf_pacf_summary(s, by=by).join(stationarity.stationarity(s, by=by), [*by])


def model_fit(df: DataFrame, family: str = "ARIMA", order=None, auto: bool = False, by=BY,
              bounded: bool = False, constant: bool = True) -> DataFrame:
    """Explore, choose an order when asked, fit, and warn about a non-stationary series without differencing.

    Order searches compare fits with a constant; ``constant`` holds for a given order.
    """
    defaults = {"AR": (1, 0, 0), "MA": (0, 0, 1), "ARMA": (1, 0, 1), "ARIMA": (1, 1, 1)}
    if family not in defaults:
        raise ValueError("family is AR, MA, ARMA or ARIMA")
    s = layout.with_index(drop_missing(df), by, bounded=bounded)
    if not auto:
        fits = fit_one(df, order or defaults[family], by, bounded, constant)
    elif family == "AR":
        fits = best_fit(ar_fit(s, range(1, 6), by=by), "aic", by)
    elif family == "MA":
        fits = best_fit(fit_orders(s, [(0, 0, q) for q in range(1, 6)], by), "aic", by)
    elif family == "ARMA":
        fits = arma_order_grid(s, by=by)
    else:
        fits = arima_order_select(s, by=by)
    tests = stationarity.stationarity(s, by=by).select(*by, "is_stationary")
    unsteady = (F.col("d") == 0) & ~F.col("is_stationary")
    return (fits.join(tests, [*by], "left")
            .withColumn("warnings", F.when(unsteady, F.lit("series may not be stationary"))))


def std_errors(fits: DataFrame, by=BY) -> DataFrame:
    """One row per parameter: estimate, standard error, t ratio."""
    names = F.concat(F.transform("phi", lambda x, i: F.concat(F.lit("phi_"), (i + 1).cast("string"))),
                     F.transform("theta", lambda x, i: F.concat(F.lit("theta_"), (i + 1).cast("string"))))
    z = F.explode(F.arrays_zip(names.alias("name"), F.concat("phi", "theta").alias("estimate"),
                               F.col("se").alias("std_error")))
    return (fits.filter("success").select(*by, z.alias("z"))
            .select(*by, "z.name", "z.estimate", "z.std_error", div(F.col("z.estimate"), F.col("z.std_error")).alias("t")))


def params_map(fits: DataFrame, by=BY) -> DataFrame:
    """Parameters by name as a map column."""
    named = lambda c: F.transform(c, lambda x, i: F.concat(F.lit(f"{c}_"), (i + 1).cast("string")))
    return fits.filter("success").select(*by, F.map_from_arrays(
        F.concat(F.array(F.lit("c"), F.lit("sigma2")), named("phi"), named("theta")),
        F.concat(F.array("c", "sigma2"), F.col("phi"), F.col("theta"))).alias("params"))


def model_summary(fits: DataFrame, by=BY) -> DataFrame:
    """A text block per fit row."""
    number = lambda label, c: F.format_string(f"{label}: %.4f", c)
    coefs = lambda c: F.transform(c, lambda x, i: F.format_string(f"{c}_%d: %.4f", i + 1, x))
    body = F.concat_ws("\n", F.format_string("ARIMA(%d,%d,%d)", "p", "d", "q"),
                       F.format_string("Observations: %d", F.col("n_obs")), coefs("phi"), coefs("theta"),
                       number("Constant", F.col("c")), number("Sigma2", F.col("sigma2")),
                       number("Log-likelihood", F.col("log_likelihood")), number("AIC", F.col("aic")),
                       number("BIC", F.col("bic")))
    failed = F.concat(F.lit("fit failed: "), F.coalesce("error", F.lit("unknown")))
    return fits.select(*by, F.when(F.col("success"), body).otherwise(failed).alias("summary"))


def model_metrics(fits: DataFrame, by=BY) -> DataFrame:
    from tidemark.operators.correlation import auto_family
    return auto_family(fits).select(*by, "family", "p", "d", "q", "aic", "bic", "log_likelihood", "sigma2")


def evaluate_model(fits: DataFrame, residual_rows: DataFrame, pairs: DataFrame, by=BY) -> DataFrame:
    """One row a model: family and orders, criteria, errors of ``pairs`` (actual, predicted), every residual diagnostic.

    Each part keeps one row a series, so they are joined as they come; a series without a fit has the row of its failure.
    """
    from tidemark.operators import accuracy, diagnostics
    head = model_metrics(fits, by).join(fits.select(*by, "aicc", "n_obs", "success"), [*by])
    head = head.withColumn("n_parameters", F.col("p") + F.col("q") + 1)
    errors = accuracy.evaluate_forecast(pairs, by)
    residuals = diagnostics.residual_report(residual_rows, by).drop("n").withColumnsRenamed({"mean": "residual_mean", "std": "residual_std"})
    return head.join(errors, [*by], "left").join(residuals, [*by], "left")


# ---------------------------------------------------------------- searches with given parameters

def grid_search(df: DataFrame, grid: dict, objective, maximize: bool = False, by=BY) -> DataFrame:
    """Best point of a parameter grid; ``objective(point)`` is an aggregate column over ``df``.

    Every point is one aggregate of the same pass: rows are read once however large the grid is.
    """
    points = [{}]
    for name, values in grid.items():
        points = [{**pt, name: v} for pt in points for v in values]
    g = df.groupBy(*by).agg(*[objective(pt).alias(f"_v{i}") for i, pt in enumerate(points)])
    scored = F.array(*[F.struct(F.col(f"_v{i}").alias("value"),
                                *[F.lit(float(v)).alias(n) for n, v in pt.items()]) for i, pt in enumerate(points)])
    usable = F.filter(scored, lambda s: s["value"].isNotNull() & ~F.isnan(s["value"]))
    flip = -1.0 if maximize else 1.0
    keyed = F.transform(usable, lambda s: F.struct((s["value"] * flip).alias("key"), s.alias("s")))
    return g.select(*by, F.array_min(keyed)["s"].alias("s")).select(*by, "s.*")


def centred_lags(df: DataFrame, lags: int = 1, by=BY, bounded: bool = False) -> DataFrame:
    """``w`` (the centred series) with its lags: the columns AR objectives are written in."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, n=F.count("*"), mean=F.avg(VALUE))
    return layout.with_lags(s.withColumn("w", F.col(VALUE) - F.col("mean")), "w", lags, by)


def param_search(df: DataFrame, values, by=BY, bounded: bool = False) -> DataFrame:
    """AR(1) start value with the highest conditional likelihood among fixed candidates."""
    rows = centred_lags(df, 1, by, bounded)

    def loglik(point):
        e = F.when(F.col(IDX) >= 1, F.col("w") - point["phi"] * F.col("lag_1")).otherwise(0.0)
        n, rss = F.count("*"), F.sum(e * e)
        return criteria.loglik(n, rss, rss / n)

    return grid_search(rows, {"phi": list(values)}, loglik, maximize=True, by=by) \
        .withColumnRenamed("value", "log_likelihood")
