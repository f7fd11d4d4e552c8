"""The tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.functions.probability import normal_quantile, z_value
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators import correlation, forecasting
from tidemark.operators.diagnostics import R, TINY


def residual_histogram(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Counts in ``min(30, max(10, n div 5))`` equal bins between smallest and largest residual."""
    s = layout.with_index(df, by, bounded=bounded)
    s = layout.with_totals(s, by, _n=F.count(R), _lo=F.min(R), _hi=F.max(R))
    bins = F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.col("_n") / 5)))
    place = F.floor(div(F.col(R) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    s = s.withColumn("bin", F.coalesce(F.least(place, bins - 1), F.lit(0)))
    return s.groupBy(*by, "bin").agg(F.count("*").alias("count"))


def qq_points(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Sorted residuals against normal quantiles, with the line through the quartiles."""
    wide = layout.needs_chunks(df, by, bounded)
    s = layout.with_index(df.select(*by, R), by, (R,), bounded=not wide)
    s = layout.with_totals(s, by, _n=F.count("*"), _s=F.stddev_pop(R)).filter((F.col("_n") >= 3) & (F.col("_s") >= TINY))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col(IDX) + 0.625) / (F.col("_n") + 0.25)))
    q = layout.quantiles(s, (0.25, 0.75), R, by)
    quarter = normal_quantile(F.lit(0.75))
    slope = (F.col("q")[1] - F.col("q")[0]) / (2.0 * quarter)
    q = q.select(*by, slope.alias("slope"), (F.col("q")[0] + slope * quarter).alias("intercept"))
    s = layout.join_series(s, q, by).withColumn("theoretical", normal_quantile(p))
    return s.select(*by, IDX, "theoretical", F.col(R).alias("sample"),
                    (F.col("intercept") + F.col("slope") * F.col("theoretical")).alias("line"))


def standardized_residuals(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, _s=F.stddev_pop(R))
    z = F.coalesce(div(F.col(R), F.col("_s")), F.lit(0.0))
    return s.select(*by, IDX, z.alias("z"), (F.abs(z) > 2).alias("outside"))


def residual_acf_table(df: DataFrame, lags: int = 20, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_index(df, by, bounded=bounded).drop(VALUE).withColumnRenamed(R, VALUE)
    a = correlation.acf(s, lags, by)
    bounds = a.select(*by, (1.96 / F.sqrt("n")).alias("bound"))
    return correlation.by_lag(a, "acf", by=by).join(bounds, [*by])


def error_by_horizon(pairs: DataFrame, squared: bool = False) -> DataFrame:
    """Mean error per step over all series."""
    e = F.col("actual") - F.col("predicted")
    return pairs.groupBy("step").agg(F.avg(e * e if squared else F.abs(e)).alias("error"), F.count("*").alias("n"))


def forecast_comparison_table(pairs: DataFrame, by=BY) -> DataFrame:
    gap = F.abs(F.col("forecast_b") - F.col("forecast_a"))
    return pairs.select(*by, "step", "forecast_a", "forecast_b", gap.alias("abs_diff"),
                        (100.0 * gap / F.greatest(F.abs("forecast_a"), F.lit(1e-12))).alias("pct_diff"))


def fan_bands(fits: DataFrame, steps: int = 12, by=BY) -> DataFrame:
    """Point forecast with 50 % and 80 % bands: one forecast, its band narrowed."""
    wide = forecasting.model_forecast(fits, steps, 0.2, by).withColumnsRenamed({"lower": "lower_80", "upper": "upper_80"})
    share = z_value(0.5) / z_value(0.2)
    inner = lambda c: F.col("forecast") + (F.col(c) - F.col("forecast")) * share
    return wide.withColumns({"lower_50": inner("lower_80"), "upper_50": inner("upper_80")})


def aicc_heatmap(fits: DataFrame, max_q: int, by=BY) -> DataFrame:
    """Lowest AICc per (p, q): one row per p, one column per q; a fit with a larger q is an error."""
    beyond = F.raise_error(F.concat(F.lit(f"order q beyond {max_q}: "), F.col("q").cast("string")))
    checked = fits.filter("success").withColumn("q", F.when(F.col("q") <= max_q, F.col("q")).otherwise(beyond))
    return (checked.groupBy(*by, "p")
            .agg(*[F.min(F.when(F.col("q") == q, F.col("aicc"))).alias(f"q{q}") for q in range(max_q + 1)]))


def window_rank_boxplot(ranks: DataFrame, by=BY) -> DataFrame:
    """Quartiles of the window ranks of each order."""
    q = F.percentile("rank", F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    g = ranks.groupBy(*by, "p", "d", "q").agg(q.alias("_b"))
    return g.select(*by, "p", "d", "q", *[F.col("_b")[i].alias(n)
                                         for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def series_with_forecast(history: DataFrame, forecasts: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """History and forecast on one position axis with a ``kind`` column."""
    s = layout.with_index(history, by, bounded=bounded)
    n = s.groupBy(*by).agg(F.max(IDX).alias("_end"))
    ahead = forecasts.join(n, [*by]).select(*by, (F.col("_end") + F.col("step")).alias(IDX),
                                            F.col("forecast").alias(VALUE), F.lit("forecast").alias("kind"))
    return s.select(*by, IDX, VALUE, F.lit("history").alias("kind")).unionByName(ahead)
