"""Window functions and time-series shaping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.layout import BY, CHUNK, IDX, SERIES, TIME, VALUE

DAY = 86_400
BLOCK = 10_000
with_index = layout.with_index


def rolling(df: DataFrame, width: int, by=BY, bounded: bool = False, **aggs: Column) -> DataFrame:
    """Trailing window of ``width`` rows, partial at the start, for any aggregates."""
    rows, w, finish = layout.neighbourhood(layout.with_index(df, by, bounded=bounded), back=width - 1, by=by)
    return finish(rows.withColumns({n: a.over(w.rowsBetween(-width + 1, 0)) for n, a in aggs.items()}))


def rolling_mean(df, width, by=BY, bounded=False) -> DataFrame:
    return rolling(df, width, by, bounded, rolling_mean=F.avg(VALUE))


def rolling_std(df, width, by=BY, bounded=False) -> DataFrame:
    return rolling(df, width, by, bounded, rolling_std=F.stddev_samp(VALUE))


def rolling_var(df, width, by=BY, bounded=False) -> DataFrame:
    return rolling(df, width, by, bounded, rolling_var=F.var_samp(VALUE))


def lag_features(df: DataFrame, lags: int, by=BY, bounded: bool = False) -> DataFrame:
    return layout.with_lags(layout.with_index(df, by, bounded=bounded), VALUE, lags, by)


def _difference(order: int) -> Column:
    """Binomial weights give the d-fold difference in one pass."""
    total = F.col(VALUE)
    for k in range(1, order + 1):
        total = total + (-1) ** k * math.comb(order, k) * F.col(f"lag_{k}")
    return total


def rebase(s: DataFrame, shift) -> DataFrame:
    """Positions after the first ``shift`` rows are gone."""
    out = s.withColumn(IDX, F.col(IDX) - shift)
    return layout.add_chunk(out) if layout.has_chunks(s) else out


def difference(df: DataFrame, order: int = 1, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_index(df, by, bounded=bounded)
    if order == 0:
        return s
    d = layout.with_lags(s, VALUE, order, by).filter(F.col(IDX) >= order).withColumn(VALUE, _difference(order))
    return rebase(d.select(*s.columns), order)


def difference_ladder(df: DataFrame, d_max: int = 2, by=BY, bounded: bool = False) -> DataFrame:
    """The series and its 1..d_max-fold differences as rows with a ``d`` column, from one window pass."""
    s = layout.with_index(df, by, bounded=bounded)
    lagged = layout.with_lags(s, VALUE, d_max, by)
    ladder = F.array(*[F.struct(F.lit(d).alias("d"), _difference(d).alias("v")) for d in range(d_max + 1)])
    rows = (lagged.select(*layout.keys(s, by), IDX, F.explode(ladder).alias("s"))
            .filter(F.col(IDX) >= F.col("s.d"))
            .withColumns({"d": F.col("s.d"), VALUE: F.col("s.v")}).drop("s"))
    return rebase(rows, F.col("d"))


def difference_columns(s: DataFrame, d_max: int, by=BY):
    """``(rows, names)``: the series and its 1..d_max-fold differences as columns, the d-th NULL in the first ``d`` rows."""
    names = [VALUE, *[f"_d{d}" for d in range(1, d_max + 1)]]
    if d_max == 0:
        return s.select(*layout.keys(s, by), IDX, VALUE), names
    lagged = layout.with_lags(s.select(*layout.keys(s, by), IDX, VALUE), VALUE, d_max, by)
    columns = [_difference(d).alias(name) for d, name in enumerate(names)]
    return lagged.select(*layout.keys(s, by), IDX, *columns), names


def last_levels(df: DataFrame, order: int, by=BY, bounded: bool = False) -> DataFrame:
    """Last value of the series and of each lower difference: what ``undifference`` starts from."""
    s = layout.with_lags(layout.with_index(df, by, bounded=bounded), VALUE, max(order - 1, 1), by)
    levels = F.array(*[_difference(k) for k in range(order)]) if order else F.array().cast("array<double>")
    return s.groupBy(*by).agg(F.max_by(levels, IDX).alias("levels"))


def undifference(diffs: DataFrame, levels: DataFrame, order: int, by=BY, bounded: bool = False) -> DataFrame:
    """Cumulate ``order`` times, each time from the matching level."""
    s = layout.join_series(layout.with_index(diffs, by, bounded=bounded), levels, by)
    for k in range(order - 1, -1, -1):
        s = (layout.with_running_sum(s, "_sum", F.col(VALUE), by)
             .withColumn(VALUE, F.get("levels", F.lit(k)) + F.col("_sum")).drop("_sum"))
    return s.drop("levels")


def _half_variances(s: DataFrame, by):
    """Rows with their length, and the two aggregates: variance of the first and of the second half."""
    s = layout.with_totals(s, by, _n=F.count("*"))
    early = F.col(IDX) < F.floor(F.col("_n") / 2)
    return s, {"first": F.var_pop(F.when(early, F.col(VALUE))), "second": F.var_pop(F.when(~early, F.col(VALUE)))}


def _variance_ratio() -> Column:
    return F.when(F.coalesce(F.col("first"), F.lit(0.0)) < 1e-10, 1.0).otherwise(div(F.col("second"), F.col("first")))


def half_variance_ratio(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    s, halves = _half_variances(layout.with_index(df, by, bounded=bounded), by)
    v = s.groupBy(*by).agg(*[a.alias(n) for n, a in halves.items()])
    return v.select(*by, _variance_ratio().alias("variance_ratio"), (_variance_ratio() > 1.5).alias("needs_log"))


def with_variance_ratio(s: DataFrame, by=BY, **more: Column) -> DataFrame:
    """``half_variance_ratio`` and any other aggregates next to every row: no second reading of the series."""
    s, halves = _half_variances(s, by)
    s = layout.with_totals(s, by, **halves, **more).withColumn("variance_ratio", _variance_ratio())
    return s.withColumn("needs_log", F.col("variance_ratio") > 1.5).drop("first", "second").withColumnRenamed("_n", "n")


def window_plan(n: Column) -> dict[str, Column]:
    """Order ceilings and window counts by series length."""
    small, medium = n < 500, n < 2000
    part = lambda k: F.floor(n / k)
    between = lambda lo, hi, x: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    pick = lambda a, b, c: F.when(small, a).when(medium, b).otherwise(c)
    return {"max_p": pick(3, 5, 5).cast("long"), "max_q": pick(3, 5, 5).cast("long"),
            "num_sliding": pick(between(3, 5, part(100)), between(5, 10, part(150)), between(10, 20, part(150))),
            "num_fixed": pick(F.greatest(F.lit(3), part(150)), F.greatest(F.lit(4), part(200)),
                              F.greatest(F.lit(5), part(250))),
            "overlap": pick(0.3, 0.2, 0.15)}


def plan_windows(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).withColumns(window_plan(F.col("n")))


def sliding_geometry(n: Column, count: Column, overlap: Column) -> dict[str, Column]:
    count = F.greatest(F.lit(1), count)
    size = F.floor(n / (count * (1 - overlap) + overlap))
    size = F.greatest(F.lit(1), F.least(size, n))
    size = F.least(n, F.greatest(size, F.least(n, F.greatest(F.lit(10), F.floor(n / (count + 5))))))
    step = F.greatest(F.lit(1), F.floor(size * (1 - overlap)))
    return {"w_size": size, "w_step": step, "w_count": F.least(count, F.floor((n - size) / step) + 1)}


def _geometry(s: DataFrame, by, num_windows, overlap) -> DataFrame:
    plan = window_plan(F.col("n"))
    count = F.lit(num_windows) if num_windows is not None else plan["num_sliding"]
    share = F.lit(overlap) if overlap is not None else plan["overlap"]
    return s.withColumns({"_count": count, "_share": share}).withColumns(
        sliding_geometry(F.col("n"), F.col("_count"), F.col("_share"))).drop("_count", "_share")


def sliding_windows(df: DataFrame, num_windows: int | None = None, overlap: float | None = None, by=BY) -> DataFrame:
    """The window table: ``window_id, start_idx, end_idx`` (end excluded); the last window reaches to the newest row."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    w = _geometry(n, by, num_windows, overlap).withColumn(
        "window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w_count") - 1)))
    start = F.col("window_id") * F.col("w_step")
    return w.select(*by, "window_id", start.alias("start_idx"), F.when(F.col("window_id") == F.col("w_count") - 1, F.col("n")).otherwise(start + F.col("w_size")).alias("end_idx"))


def assign_sliding(df: DataFrame, num_windows: int | None = None, overlap: float | None = None, by=BY,
                   bounded: bool = False) -> DataFrame:
    """Every row once per covering window, by arithmetic on its position: no join.

    Positions restart in each window; group by ``(*by, window_id)`` afterwards.
    """
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, n=F.count("*"))
    g = _geometry(s, by, num_windows, overlap)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(IDX) - F.col("w_size") + 1) / F.col("w_step")))
    last = F.least(F.floor(F.col(IDX) / F.col("w_step")), F.col("w_count") - 1)
    first = F.least(first, F.col("w_count") - 1)  # the last window reaches to the newest row
    g = (g.filter(first <= last)
         .withColumn("window_id", F.explode(F.sequence(first, last)))
         .withColumn("_start", F.col("window_id") * F.col("w_step")))
    out = g.withColumn(IDX, F.col(IDX) - F.col("_start"))
    cols = [c for c in s.columns if c not in ("n", CHUNK)] + ["window_id"]
    return layout.add_chunk(out).select(*cols, CHUNK) if layout.has_chunks(s) else out.select(*cols)


def fixed_windows(df: DataFrame, p=1, q=1, num_windows: int | None = None, train_share: float = 0.7, by=BY,
                  bounded: bool = False) -> DataFrame:
    """Non-overlapping windows with a chronological train / test role; ``p`` and ``q`` may be columns.

    Rows after the last window that is long enough belong to it, so every series of usable length is covered to its end.
    """
    s = layout.with_index(df, by, bounded=bounded)
    extra = [c for c in s.columns if c not in (CHUNK,)]
    s = layout.with_totals(s, by, _n=F.count("*"))
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    need = F.greatest(as_col(p), as_col(q)) + 10
    least = F.floor(need / train_share) + 10
    count = F.lit(num_windows) if num_windows is not None else window_plan(F.col("_n"))["num_fixed"]
    g = s.withColumns({"_need": need, "_least": least, "_count": count})
    g = g.withColumn("_size", F.greatest(F.floor(F.col("_n") / F.col("_count")), F.col("_least")))
    full = F.floor(F.col("_n") / F.col("_size"))
    rest = F.when(F.col("_n") - full * F.col("_size") >= F.col("_least"), 1).otherwise(0)
    g = g.withColumn("_windows", F.least(F.col("_count"), full + rest)).filter("_windows > 0")
    final = F.col("_windows") - 1
    g = g.withColumn("window_id", F.least(F.floor(F.col(IDX) / F.col("_size")), final))
    g = g.withColumn("_len", F.when(F.col("window_id") == final, F.col("_n") - final * F.col("_size")).otherwise(F.col("_size")))
    g = g.withColumn("train_size", F.floor(F.col("_len") * train_share)).filter(F.col("train_size") >= F.col("_need"))
    g = g.withColumn(IDX, F.col(IDX) - F.col("window_id") * F.col("_size"))
    g = g.withColumn("role", F.when(F.col(IDX) < F.col("train_size"), "train").otherwise("test"))
    cols = [*extra, "window_id", "train_size", "role"]
    return layout.add_chunk(g).select(*cols, CHUNK) if layout.has_chunks(s) else g.select(*cols)


def consecutive_failures(diagnostics: DataFrame, by=BY, passed: str = "overall_pass") -> DataFrame:
    """Do two neighbouring windows fail?  Input has one row per window."""
    failed = diagnostics.filter(~F.col(passed))
    gap = F.col("window_id") - F.lag("window_id").over(Window.partitionBy(*by).orderBy("window_id"))
    return (failed.withColumn("_gap", gap).groupBy(*by)
            .agg(F.count("*").alias("failed_windows"),
                 F.coalesce(F.bool_or(F.col("_gap") == 1), F.lit(False)).alias("needs_adjustment")))


def seasonal_decompose(df: DataFrame, period: int, model: str = "additive", by=BY, bounded: bool = False) -> DataFrame:
    """Centred moving average, mean of the rest per phase, residual."""
    if model not in ("additive", "multiplicative"):
        raise ValueError("model is additive or multiplicative")
    half = period // 2
    rows, w, finish = layout.neighbourhood(layout.with_index(df, by, bounded=bounded), half, half, by)
    s = finish(rows.withColumn("trend", F.avg(VALUE).over(w.rowsBetween(-half, half))))
    y, trend = F.col(VALUE), F.col("trend")
    rest = y - trend if model == "additive" else div(y, trend)
    s = s.withColumn("_rest", rest).withColumn("phase", F.pmod(IDX, F.lit(period)))
    s = layout.with_totals(s, (*by, "phase"), seasonal=F.avg("_rest"))
    residual = (y - trend - F.col("seasonal") if model == "additive"
                else div(y, trend * F.col("seasonal")))
    return s.withColumn("residual", residual).drop("_rest")


def number_rows(df: DataFrame, count: str, out: str) -> DataFrame:
    """``out`` = 0 .. count-1 as rows, in two steps so that no long array is ever built."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {BLOCK}")))
    d = df.filter(F.col(count) > 0).withColumn("_b", block)
    last = F.least(F.col("_b") * BLOCK + BLOCK - 1, F.col(count) - 1)
    return d.withColumn(out, F.explode(F.sequence(F.col("_b") * BLOCK, last))).drop("_b")



def resample(df: DataFrame, seconds: int, agg: str = "mean") -> DataFrame:
    """New frequency; bins start at midnight of the first day; empty bins are NULL (mean) or 0 (sum).

    Rows collapse, with map-side partial sums, to a grid that every bin edge lies on; the cells also carry first and last
    time.  They are written once, so the table is read once.  A series' range comes from one small row for each ``BLOCK`` cells, and
    goes back to the cells by (series, block): no join has the series alone as its key.
    """
    if agg not in ("mean", "sum"):
        raise ValueError("agg is mean or sum")
    grid = math.gcd(seconds, DAY) * 1_000_000
    width = seconds * 1_000_000
    present = df.filter(F.col(VALUE).isNotNull() & F.col(TIME).isNotNull())
    wall = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(TIME).cast("timestamp_ntz"))
    cell = F.floor(wall / grid).cast("long")
    cells = layout.durable(
        present.groupBy(SERIES, cell.alias("cell"))
        .agg(F.sum(VALUE).alias("s"), F.count(VALUE).alias("c"), F.min(wall).alias("lo"), F.max(wall).alias("hi"))
        .withColumn("block", F.floor(F.col("cell") / BLOCK)))
    day, whole = DAY * 1_000_000, Window.partitionBy(SERIES)
    reach = cells.groupBy(SERIES, "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    reach = reach.withColumns({"lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole), "_least": F.min("block").over(whole)})
    reach = reach.withColumn("origin", (F.floor(F.col("lo") / day) * day).cast("long"))
    bins = (cells.join(reach.select(SERIES, "block", "origin"), [SERIES, "block"])
            .groupBy(SERIES, F.floor((F.col("cell") * grid - F.col("origin")) / width).alias("bin"))
            .agg(F.sum("s").alias("s"), F.sum("c").alias("c")))
    first = F.floor((F.col("lo") - F.col("origin")) / width)
    every = number_rows(
        reach.filter("block = _least").withColumn("_first", first)
        .withColumn("_n", (F.floor((F.col("hi") - F.col("origin")) / width) - first + 1)), "_n", "_k")
    every = every.select(SERIES, "origin", (F.col("_first") + F.col("_k")).alias("bin"))
    value = div(F.col("s"), F.col("c")) if agg == "mean" else F.coalesce(F.col("s"), F.lit(0.0))
    start = F.timestamp_add("MICROSECOND", F.col("origin") + F.col("bin") * width,
                            F.lit("1970-01-01").cast("timestamp_ntz"))
    return every.join(bins, [SERIES, "bin"], "left").select(SERIES, start.alias(TIME), value.alias(VALUE))


def resample_calendar(df: DataFrame, unit: str, agg: str = "mean") -> DataFrame:
    """Calendar bins: ``week``, ``month``, ``quarter`` or ``year``, empty ones included."""
    months = {"month": 1, "quarter": 3, "year": 12}
    step = F.expr("interval 7 days") if unit == "week" else F.expr(f"interval {months[unit]} months")
    present = df.filter(F.col(VALUE).isNotNull() & F.col(TIME).isNotNull())
    start = F.date_trunc(unit, TIME).cast("timestamp_ntz")
    bins = present.groupBy(SERIES, start.alias(TIME)).agg(F.sum(VALUE).alias("s"), F.count(VALUE).alias("c"))
    every = (bins.groupBy(SERIES).agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
             .select(SERIES, F.explode(F.sequence("lo", "hi", step)).alias(TIME)))
    value = div(F.col("s"), F.col("c")) if agg == "mean" else F.coalesce(F.col("s"), F.lit(0.0))
    return every.join(bins, [SERIES, TIME], "left").select(SERIES, TIME, value.alias(VALUE))
