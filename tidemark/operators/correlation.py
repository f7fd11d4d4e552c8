"""Autocorrelation, partial autocorrelation and what order selection reads off them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import div, dot, let
from tidemark.functions.probability import z_value
from tidemark.layout import BY, IDX, VALUE

DEFAULT_LAGS = 40


def acf_arrays(s: DataFrame, lags: int, by=BY) -> DataFrame:
    """``(by, n, c0, acf[0..lags])`` of an indexed series without missing values.

    The series is centred first, all lags are columns of one window pass and one aggregate sums them.
    """
    c = layout.with_totals(s, by, _m=F.avg(VALUE)).withColumn("_c", F.col(VALUE) - F.col("_m"))
    c = layout.with_lags(c.select(*layout.keys(s, by), IDX, "_c"), "_c", lags, by)
    sums = [F.coalesce(F.sum(F.col("_c") * F.col(f"lag_{k}")), F.lit(0.0)).alias(f"s{k}")
            for k in range(1, lags + 1)]
    g = c.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("c0"), *sums)
    rho = F.array(F.lit(1.0), *[F.when(F.col("c0") > 0, F.col(f"s{k}") / F.col("c0")).otherwise(1.0)
                                for k in range(1, lags + 1)])
    return g.select(*by, "n", "c0", rho.alias("acf"))


def acf(df: DataFrame, max_lags: int | None = None, by=BY, bounded: bool = False) -> DataFrame:
    """One array per series; a constant series gives ones; fewer than two values give no row.

    Default depth is ``min(n div 4, 40)``, otherwise ``min(max_lags, n - 1)``.
    """
    s = layout.with_index(df, by, bounded=bounded)
    a = acf_arrays(s, DEFAULT_LAGS if max_lags is None else max_lags, by)
    depth = (F.least(F.floor(F.col("n") / 4), F.lit(DEFAULT_LAGS)) if max_lags is None
             else F.least(F.lit(max_lags), F.col("n") - 1))
    return a.filter("n >= 2").withColumn("acf", F.slice("acf", F.lit(1), (depth + 1).cast("int")))


def levinson(rho: Column) -> Column:
    """Durbin-Levinson recursion as an array fold: ``struct(phi, pacf)``; tiny denominators give 0."""
    first = F.get(rho, F.lit(1))
    start = F.struct(F.array(first).alias("phi"), F.array(F.lit(1.0), first).alias("pacf"))

    def step(state, k):
        past = F.slice(rho, F.lit(2), k - 1)
        den = 1.0 - dot(state["phi"], past)
        new = F.when(F.abs(den) < 1e-10, 0.0).otherwise(
            div(F.get(rho, k) - dot(state["phi"], F.reverse(past)), den))
        return let(new, state, lambda s, f: F.struct(
            F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - f * b), F.array(f)).alias("phi"),
            F.concat(s["pacf"], F.array(f)).alias("pacf")))

    orders = F.when(F.size(rho) > 2, F.sequence(F.lit(2), F.size(rho) - 1)).otherwise(
        F.array().cast("array<int>"))
    empty = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("pacf"))
    return F.when(F.size(rho) > 1, F.aggregate(orders, start, step)).otherwise(empty)


def pacf_from_acf(a: DataFrame) -> DataFrame:
    return a.withColumn("pacf", levinson(F.col("acf"))["pacf"])


def pacf(df: DataFrame, max_lags: int | None = None, by=BY, bounded: bool = False) -> DataFrame:
    return pacf_from_acf(acf(df, max_lags, by, bounded))


def by_lag(a: DataFrame, *columns: str, by=BY) -> DataFrame:
    """Array form to one row per lag."""
    zipped = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(columns[0]) - 1).alias("lag"), *columns))
    return a.select(*by, zipped.alias("z")).select(*by, F.col("z.lag").cast("long").alias("lag"),
                                                   *[f"z.{c}" for c in columns])


def yule_walker(df: DataFrame, order: int, by=BY, bounded: bool = False) -> DataFrame:
    """AR start values: the last Durbin-Levinson row solves the Toeplitz system."""
    a = acf(df, order, by, bounded)
    return a.select(*by, levinson(F.col("acf"))["phi"].alias("phi"))


def ma_moments(df: DataFrame, order: int, by=BY, bounded: bool = False) -> DataFrame:
    """MA start values: the first correlations, kept inside +-0.99."""
    a = acf(df, order, by, bounded)
    return a.select(*by, F.transform(F.slice("acf", 2, order), lambda r: F.greatest(
        F.least(r, F.lit(0.99)), F.lit(-0.99))).alias("theta"))


def _significant(values: Column, bound: Column) -> Column:
    lags = F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1)))
    return F.filter(lags, lambda k: F.coalesce(F.abs(F.get(values, k)) > bound, F.lit(False)))


def _last(lags: Column) -> Column:
    return F.coalesce(F.array_max(lags), F.lit(0))


def acf_pacf_summary(df: DataFrame, max_lags: int | None = None, by=BY, bounded: bool = False) -> DataFrame:
    """First significant lag of each: PACF suggests p, ACF suggests q."""
    bound = 1.96 / F.sqrt("n")
    a = pacf(df, max_lags, by, bounded).withColumn("bound", bound)
    return a.select(*by, "n", "bound", "acf", "pacf",
                    F.coalesce(F.get(_significant(F.col("pacf"), F.col("bound")), F.lit(0)), F.lit(0)).alias("suggested_p"),
                    F.coalesce(F.get(_significant(F.col("acf"), F.col("bound")), F.lit(0)), F.lit(0)).alias("suggested_q"))


def order_bounds(df: DataFrame, alpha: float = 0.05, max_lag: int | None = None, min_order: int = 1,
                 max_p: int | None = None, max_q: int | None = None, by=BY, bounded: bool = False) -> DataFrame:
    """Ceilings for a (p, q) grid from significant lags; apply to an already differenced series."""
    z = z_value(alpha)
    a = pacf(df, max_lag, by, bounded)

    def bartlett(state, k):
        r = F.get(F.col("acf"), k)
        over = F.abs(r) > z * F.sqrt((1.0 + 2.0 * state["sq"]) / F.col("n"))
        return F.struct((state["sq"] + r * r).alias("sq"), F.when(over, k).otherwise(state["last"]).alias("last"))

    lags = F.when(F.size("acf") > 1, F.sequence(F.lit(1), F.size("acf") - 1)).otherwise(F.array().cast("array<int>"))
    last_q = F.aggregate(lags, F.struct(F.lit(0.0).alias("sq"), F.lit(0).alias("last")), bartlett)["last"]
    last_p = _last(_significant(F.col("pacf"), z / F.sqrt("n")))

    def ceiling(last, cap):
        structural = F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.lit(5 if cap is None else cap))
        found = F.when(last > 0, last).otherwise(min_order)
        value = F.greatest(F.lit(min_order), F.least(found, structural))
        value = F.when(F.col("n") < 10, F.lit(max(min_order, 1))).otherwise(value)
        return (value if cap is None else F.least(value, F.lit(cap))).cast("long")

    return a.select(*by, "n", ceiling(last_p, max_p).alias("max_p"), ceiling(last_q, max_q).alias("max_q"))


def ar_order_pacf(df: DataFrame, max_order: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    """Last significant PACF lag, at most ``max_order``."""
    a = pacf(df, None, by, bounded)
    return a.select(*by, F.least(_last(_significant(F.col("pacf"), 1.96 / F.sqrt("n"))),
                                 F.lit(max_order)).cast("long").alias("p"))


def ma_order_acf(df: DataFrame, max_order: int = 5, by=BY, bounded: bool = False) -> DataFrame:
    a = acf(df, None, by, bounded)
    return a.select(*by, F.least(_last(_significant(F.col("acf"), 1.96 / F.sqrt("n"))),
                                 F.lit(max_order)).cast("long").alias("q"))


def auto_family(orders: DataFrame) -> DataFrame:
    """Name the model family of ``(p, d, q)``."""
    p, d, q = F.col("p"), F.col("d"), F.col("q")
    return orders.withColumn("family", F.when(d > 0, "ARIMA").when((p > 0) & (q > 0), "ARMA")
                             .when((p == 0) & (q > 0), "MA").otherwise("AR"))


