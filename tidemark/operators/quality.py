"""Series statistics, outliers, seasonality, trend, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import INFINITY, div
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators import correlation
from tidemark.operators.cleaning import drop_missing

MIN_LENGTH, MAX_MISSING = 3, 0.10
SEASONAL_PERIODS = (4, 7, 12, 24)
SEASONAL_ACF, TREND_R2 = 0.3, 0.1



def require_min_length(df: DataFrame, minimum: int = 10, by=BY) -> DataFrame:
    """One row per series: enough observations to fit, or a status that says why not."""
    n = F.count(VALUE)
    return df.groupBy(*by).agg(n.alias("n")).withColumn(
        "status", F.when(F.col("n") < minimum, F.concat(
            F.lit("series too short: "), F.col("n").cast("string"), F.lit(f" < {minimum}"))).otherwise("ok"))


def require_window_length(windows: DataFrame, n: str = "n") -> DataFrame:
    """``success`` / ``error`` per task row with columns ``p, d, q``."""
    need = F.greatest(F.col("p") + F.col("d") + F.col("q") + 10, F.lit(30))
    return (windows.withColumn("success", F.col(n) >= need)
            .withColumn("error", F.when(F.col(n) < need, F.format_string(
                "window too short: %d < %d", F.col(n), need))))


def require_complete(df: DataFrame, by=BY) -> DataFrame:
    bad = F.col(VALUE).isNull() | F.isnan(VALUE) | (F.abs(VALUE) == INFINITY)
    return df.groupBy(*by).agg((~F.bool_or(bad)).alias("complete"))


def check_infinite(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(
        F.coalesce(F.bool_or(F.abs(VALUE) == INFINITY), F.lit(False)).alias("has_infinite"))


def check_constant(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg((F.min(VALUE) == F.max(VALUE)).alias("is_constant"))


def series_info(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    return (basic_stats(df, by, bounded, empty=None)
            .select(*by, "length", "mean", "std", "min", "max", "median"))


def basic_stats(df: DataFrame, by=BY, bounded: bool = False, empty=0.0) -> DataFrame:
    """Statistics of the non-missing values; ``length`` counts every row; nothing present gives zeros."""
    probs = (0.25, 0.5, 0.75)
    moments = [F.count("*").alias("length"), F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("std"),
               F.min(VALUE).alias("min"), F.max(VALUE).alias("max")]
    if layout.needs_chunks(df, by, bounded):
        ranked = df if layout.has_chunks(df) else layout.with_index(df, by)
        stats = df.groupBy(*by).agg(*moments).join(layout.quantiles(ranked, probs, by=by), [*by], "left")
    else:
        stats = df.groupBy(*by).agg(*moments, F.percentile(
            VALUE, F.array(*[F.lit(p) for p in probs])).alias("q"))
    stats = stats.select(*by, "length", "mean", "std", "min", "max", F.col("q")[1].alias("median"),
                         F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))
    if empty is None:
        return stats
    return stats.fillna(empty, ["mean", "std", "min", "max", "median", "q25", "q75"])


def missing_report(df: DataFrame, by=BY) -> DataFrame:
    gone = F.col(VALUE).isNull()
    return df.groupBy(*by).agg(F.count_if(gone).alias("missing_count"),
                               F.avg(gone.cast("int")).alias("missing_ratio"),
                               F.bool_or(gone).alias("has_missing"))


def missing_positions(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Positions of the missing values, one row each (a list could grow with the series)."""
    return (layout.with_index(df, by, bounded=bounded)
            .filter(F.col(VALUE).isNull()).select(*by, IDX))


def _present(df: DataFrame, by, bounded) -> DataFrame:
    return layout.with_index(drop_missing(df), by, bounded=bounded)


def outliers_iqr(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    s = _present(df, by, bounded)
    fences = (layout.quantiles(s, (0.25, 0.75), by=by)
              .select(*by, (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("lower"),
                      (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("upper"))
              .join(s.groupBy(*by).agg(F.count("*").alias("_n")), [*by]).filter("_n >= 4").drop("_n"))
    return (layout.join_series(s, fences, by)
            .filter((F.col(VALUE) < F.col("lower")) | (F.col(VALUE) > F.col("upper")))
            .select(*by, IDX, VALUE))


def outliers_zscore(df: DataFrame, threshold: float = 3.0, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_totals(_present(df, by, bounded), by, _n=F.count("*"), _m=F.avg(VALUE), _s=F.stddev_pop(VALUE))
    z = div(F.col(VALUE) - F.col("_m"), F.col("_s"))
    return (s.withColumn("z", z).filter((F.col("_n") >= 4) & (F.abs("z") > threshold))
            .select(*by, IDX, VALUE, "z"))


def outliers_modified_zscore(df: DataFrame, threshold: float = 3.5, by=BY, bounded: bool = False) -> DataFrame:
    """Distance from the median in median absolute deviations; a zero deviation has no outliers."""
    s = _present(df, by, bounded)
    med = layout.quantiles(s, [0.5], by=by).select(*by, F.col("q")[0].alias("_med"))
    d = layout.join_series(s, med, by).withColumn("_dev", F.abs(F.col(VALUE) - F.col("_med")))
    mad = layout.quantiles(d, [0.5], "_dev", by).select(*by, F.col("q")[0].alias("_mad"))
    d = layout.join_series(d, mad, by).withColumn(
        "z", div(0.6745 * (F.col(VALUE) - F.col("_med")), F.col("_mad")))
    return d.filter(F.abs("z") > threshold).select(*by, IDX, VALUE, "z")


OUTLIERS = {"iqr": outliers_iqr, "zscore": outliers_zscore, "modified_zscore": outliers_modified_zscore}


def detect_seasonality(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    a = correlation.acf_arrays(_present(df, by, bounded), max(SEASONAL_PERIODS), by)
    top = F.least(F.floor(F.col("n") / 4), F.lit(max(SEASONAL_PERIODS)))
    strong = F.filter(F.array(*[F.lit(k) for k in SEASONAL_PERIODS]), lambda k: (
        (F.col("n") >= 12) & (F.col("c0") > 0) & (k <= top) & (F.abs(F.get("acf", k)) > SEASONAL_ACF)))
    return a.select(*by, strong.alias("seasonal_periods"), (F.size(strong) > 0).alias("has_seasonality"))


def detect_trend(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Least-squares line over position; ``has_trend`` when it explains more than a tenth of the variance."""
    t = _present(df, by, bounded).groupBy(*by).agg(
        F.count("*").alias("_n"), F.regr_slope(VALUE, IDX).alias("slope"),
        F.regr_r2(VALUE, IDX).alias("r_squared"), F.min(VALUE).alias("_lo"), F.max(VALUE).alias("_hi"))
    r2 = F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(F.col("r_squared"))
    ok = F.col("_n") >= 3
    slope = F.when(ok, F.col("slope"))
    return t.select(*by, slope.alias("slope"), F.when(ok, r2).alias("r_squared"),
                    F.coalesce(ok & (r2 > TREND_R2), F.lit(False)).alias("has_trend"),
                    F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("none")
                    .alias("trend_direction"))


def validate_series(df: DataFrame, method: str = "iqr", by=BY, bounded: bool = False) -> DataFrame:
    """One row per series: ``is_valid, issues, warnings``, statistics, seasonality and trend."""
    wide = layout.needs_chunks(df, by, bounded)
    s = layout.with_index(df, by, bounded=not wide)
    outliers = OUTLIERS[method](s, by=by, bounded=not wide).groupBy(*by).agg(F.count("*").alias("outlier_count"))
    report = (series_info(s, by)
              .join(missing_report(s, by), [*by]).join(check_infinite(s, by), [*by])
              .join(outliers, [*by], "left")
              .join(detect_seasonality(s, by, bounded=not wide), [*by], "left")
              .join(detect_trend(s, by, bounded=not wide), [*by], "left")
              .fillna(0, ["outlier_count"]).fillna(False, ["has_seasonality", "has_trend"]))
    pct = lambda c: F.format_string("%.2f%%", c * 100)
    present = F.col("length") - F.col("missing_count")
    issues = F.array_compact(F.array(
        F.when(F.col("length") < MIN_LENGTH, F.format_string(f"Data too short: %d < {MIN_LENGTH}", F.col("length"))),
        F.when(F.col("missing_ratio") > MAX_MISSING, F.concat(
            F.lit("Too many missing values: "), pct(F.col("missing_ratio")), F.lit(f" > {MAX_MISSING:.2%}"))),
        F.when(F.col("has_infinite"), F.lit("Infinite values detected"))))
    warnings = F.array_compact(F.array(
        F.when(F.col("has_missing") & (F.col("missing_ratio") <= MAX_MISSING), F.concat(
            F.lit("Missing values detected: "), pct(F.col("missing_ratio")))),
        F.when(F.col("min") == F.col("max"), F.lit("Constant data detected")),
        F.when(F.col("outlier_count") > 0, F.concat(
            F.lit("Outliers detected: "), F.col("outlier_count").cast("string"), F.lit(" ("),
            pct(div(F.col("outlier_count"), present)), F.lit(")")))))
    return report.withColumn("issues", issues).withColumn("warnings", warnings).withColumn(
        "is_valid", F.size("issues") == 0)


def quality_report(validation: DataFrame, by=BY) -> DataFrame:
    """The validation rows as text."""
    number = lambda label, c: F.format_string(f"  {label}: %.6f", F.col(c))
    bullets = lambda c: F.transform(c, lambda m: F.concat(F.lit("  - "), m))
    block = lambda title, c: F.when(F.size(c) > 0, F.concat_ws("\n", F.lit(title), bullets(F.col(c))))
    return validation.select(*by, F.concat_ws(
        "\n", F.lit("Data Quality Report"), F.lit("Data Information:"),
        F.format_string("  Length: %d", F.col("length")), number("Mean", "mean"), number("Std", "std"),
        number("Min", "min"), number("Max", "max"), number("Median", "median"),
        block("Issues Found:", "issues"), block("Warnings:", "warnings"),
        F.concat(F.lit("Overall Status: "), F.when(F.col("is_valid"), "VALID").otherwise("INVALID"))
    ).alias("report"))


def explore_series(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Statistics plus the first 20 ACF / PACF values; series under 10 values give no row."""
    s = _present(df, by, bounded)
    a = correlation.pacf_from_acf(correlation.acf(s, by=by))
    return (basic_stats(s, by).filter("length >= 10").join(a, [*by])
            .select(*by, "length", "mean", "std", "min", "max", "median", "q25", "q75",
                    F.slice("acf", 1, 20).alias("acf"), F.slice("pacf", 1, 20).alias("pacf")))
