"""Unit-root and stationarity tests, differencing order, root checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions.guards import div, let
from tidemark.layout import BY, IDX, VALUE
from tidemark.operators.regression import nested_rss, solve_many, squares
from tidemark.operators.shaping import difference_columns

# Critical values at 1 %, 5 %, 10 %.
ADF_CRITICAL = {"c": (-3.43, -2.86, -2.57), "ct": (-3.96, -3.41, -3.12), "n": (-2.58, -1.95, -1.62)}
KPSS_CRITICAL = {"c": (0.739, 0.463, 0.347), "ct": (0.216, 0.146, 0.119)}
MAX_LAGS = 12

ADF_RESULT = T.StructType([T.StructField("stat", T.DoubleType()), T.StructField("lags", T.LongType())])


FIXED = {"n": 0, "c": 1, "ct": 2}  # deterministic terms
DOUBLES = T.ArrayType(T.DoubleType())
SUMS = (T.StructField("d", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("g", DOUBLES),
        T.StructField("at", T.ArrayType(T.LongType())), T.StructField("v", DOUBLES), T.StructField("rows", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("total", T.DoubleType()), T.StructField("walk", T.DoubleType()), T.StructField("walk2", T.DoubleType()),
        T.StructField("lrv", T.DoubleType()))


def _design(past, now, trend, base: str):
    """Regressors of one equation in gram order: deterministic terms, level, differences, target."""
    terms = {"n": [], "c": [1.0], "ct": [1.0, trend]}[base]
    steps = [past[j] - past[j + 1] for j in range(len(past) - 1)]
    return [*terms, past[0], *steps, now - past[0]]


def _newey_west_lags(n):
    return np.minimum(np.floor(4 * (n / 100.0) ** (2.0 / 9.0)), n // 4).astype(np.int64)


def _shifts(v: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """``v`` shifted by 1, 2, .. ``back`` rows, one row each; 0 where a series has no such value."""
    past = np.zeros((back, len(v)))
    for k in range(1, back + 1):
        past[k - 1, k:] = v[:-k]
    near = np.flatnonzero(place < back)
    past[:, near] = np.where(place[near] >= np.arange(1, back + 1)[:, None], past[:, near], 0.0)
    return past


def _joined(a: dict, b: dict) -> dict:
    """The sums of two neighbouring pieces of one group; the cumulated sum of ``b`` starts where ``a`` ends."""
    out, o = dict(b), a["total"]
    out |= {c: a[c] + b[c] for c in ("rows", "known", "total", "lrv")}
    out |= {"first": a["first"], "walk": a["walk"] + o * b["rows"] + b["walk"], "walk2": a["walk2"] + o * o * b["rows"] + 2.0 * o * b["walk"] + b["walk2"]}
    if b["g"] is not None:
        out |= {"g": a["g"] + b["g"], "at": np.concatenate([a["at"], b["at"]]), "v": np.concatenate([a["v"], b["v"]])}
    return out


def _sum_batches(batches, by, groups, levels, residuals, regression: str, limit: int):
    """``_sums`` of one task: frames of ordered rows in, frames of one row per group and ``d`` out."""
    size = FIXED[regression] + 1 + limit + 1
    i, j = np.triu_indices(size)
    names, held, back, pending = [*by, *[f.name for f in SUMS]], None, 1, {}

    def framed(rows):
        return pd.DataFrame({c: [r[c] for r in rows] for c in names})

    for batch in batches:
        if not len(batch):
            continue
        skip = 0 if held is None else len(held)
        every = batch if held is None else pd.concat([held, batch], ignore_index=True)
        ids = [every[k].to_numpy() for k in groups]
        new = np.zeros(len(every), dtype=bool)
        new[0] = held is None
        for column in ids:
            changed = column[1:] != column[:-1]
            if column.dtype.kind != "O":  # a missing number or time differs from itself
                changed &= ~(pd.isna(column[1:]) & pd.isna(column[:-1]))
            new[1:] |= changed
        goes_on, new[skip] = not new[skip], True  # a piece of the batch before goes on
        starts = skip + np.flatnonzero(new[skip:])
        edges = list(zip(starts.tolist(), [*starts[1:].tolist(), len(every)]))
        at, n, own = every[IDX].to_numpy(), every["n"].to_numpy(), every["_own"].to_numpy().astype(bool)
        back = max(limit + 1 if levels else 1, int(_newey_west_lags(n[starts]).max()) if residuals else 1)
        keyed = [every[k].to_numpy()[starts] for k in by]
        done = []
        for d in range(max(len(levels), len(residuals))):
            place, length = at - d, n - d
            mine = own & (place >= 0)
            rows, values, past = [], None, None
            owned = [a + np.flatnonzero(mine[a:b]) for a, b in edges]
            if levels:
                values = levels[d]
                v = every[values].to_numpy(dtype=float)
                past = _shifts(v, place, back)
                x = np.empty((size, len(v)))
                for c, term in enumerate(_design(past[:limit + 1], v, place / length.clip(1), regression)):
                    x[c] = term
                x[-1, ~every[f"{values}_known"].to_numpy().astype(bool)] = 0.0  # no step where the value is missing
                x[:, ~(mine & (place > np.minimum(limit, length // 4)))] = 0.0
                early = [e[:limit + 2][place[e[:limit + 2]] < limit + 2] for e in owned]
                grams = [((x[:, a:b] @ x[:, a:b].T)[i, j], place[e], v[e]) for (a, b), e in zip(edges, early)]
            if residuals:
                v = every[residuals[d]].to_numpy(dtype=float)
                past = past if residuals[d] == values else _shifts(v, place, back)
                there, flat = every[f"{residuals[d]}_known"].to_numpy().astype(bool), np.where(mine, v, 0.0)
                deep = _newey_west_lags(length[starts].clip(0)).tolist()
            for p, ((a, b), e) in enumerate(zip(edges, owned)):
                row = {"d": d, "n": length[a], "first": place[e[0]] if len(e) else place[a], "rows": len(e), "known": 0, "total": 0.0,
                       "walk": 0.0, "walk2": 0.0, "lrv": 0.0}
                row |= {k: column[p] for k, column in zip(by, keyed)}
                row["g"], row["at"], row["v"] = grams[p] if levels else (None, None, None)
                if residuals and len(e):
                    walk, here, k = np.cumsum(flat[e]), flat[a:b], deep[p]
                    weights = 2.0 - 2.0 / (k + 1.0) * np.arange(1, k + 1)
                    row |= {"known": int(np.count_nonzero(there[e])), "total": walk[-1], "walk": walk.sum(), "walk2": walk @ walk,
                            "lrv": here @ here + weights @ (past[:k, a:b] @ here)}
                rows.append(row)
            if goes_on:
                rows[0] = _joined(pending[d], rows[0]) if pending[d]["rows"] else rows[0]
            elif d in pending:
                done.append(pending[d])
            done += rows[:-1]
            pending[d] = rows[-1]
        done = [r for r in done if r["rows"]]
        if done:
            yield framed(done)
        held = every.iloc[max(len(every) - back, 0):]
    done = [r for r in pending.values() if r["rows"]]
    if done:
        yield framed(done)


def _sums(s: DataFrame, levels, residuals, by, regression: str = "c", limit: int = 0) -> DataFrame:
    """What the tests sum, one row per group (chunk) and difference ``d``, from one pass over ordered rows.

    ``levels[d]`` names the column the Dickey-Fuller equations read, ``residuals[d]`` the one that is cumulated and whose
    autocovariances are taken; either list may be empty.  Both start at position ``d``, and ``n`` stands next to every row.  Lags are
    shifts inside a batch and the end of the one before; the caller's windows over the groups, or the split by chunk here, keep what
    belongs together in one task.
    """
    by, groups, named = list(by), layout.keys(s, by), [*dict.fromkeys([*levels, *residuals])]
    depth = int(_newey_west_lags(np.array([max(layout.longest(s, by), 1)]))[0]) if residuals and layout.has_chunks(s) else 0
    rows = s.select(*groups, IDX, "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in named],
                    *[F.col(c).isNotNull().alias(f"{c}_known") for c in named])
    rows, _, _ = layout.neighbourhood(rows, back=max(limit + 1, depth), by=by)
    if layout.has_chunks(s):
        rows = rows.withColumn("_own", F.col(layout.CHUNK) == F.col("_home")).drop("_home").repartition(*groups)
    else:
        rows = rows.withColumn("_own", F.lit(True))
    schema = T.StructType([*[s.schema[k] for k in by], *SUMS])
    return rows.sortWithinPartitions(*groups, IDX).mapInPandas(
        lambda batches: _sum_batches(batches, by, groups, levels, residuals, regression, limit), schema)


def _merged(sums: DataFrame, by, chunked: bool, equations: int = 0) -> DataFrame:
    """The sums of a group's chunks as one row; a cumulated sum starts where the chunks before it end."""
    keys = [*by, "d"]
    if chunked:
        before = F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        o = F.col("_before")
        aggs = [F.max("n").alias("n"), F.sum("lrv").alias("lrv"), F.sum("known").alias("known"),
                F.sum(o * o * F.col("rows") + 2.0 * o * F.col("walk") + F.col("walk2")).alias("walk2")]
        if equations:
            aggs += [F.expr(f"array({', '.join(f'sum(g[{c}])' for c in range(equations * (equations + 1) // 2))})").alias("g"),
                     F.transform(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "v")))), lambda p: p["v"]).alias("v")]
        sums = sums.withColumn("_before", before).groupBy(*keys).agg(*aggs)
    return sums.withColumn("lrv", F.greatest(F.col("lrv") / F.col("n"), F.lit(1e-10)))


def _adf_stats(gram: np.ndarray, h: np.ndarray, known: np.ndarray, m: np.ndarray, base: str, limit: int, choose: bool):
    """Statistics and lags of many groups; ``h``: first values of each (``known`` of them), ``m``: lengths (4 at least)."""
    fixed, size = FIXED[base], gram.shape[1]
    top = np.minimum(limit, m // 4)

    def part(g, lags):
        keep = [*range(fixed + 1 + lags), size - 1]
        return g[:, keep][:, :, keep]

    used, best = top.copy(), np.full(len(m), math.inf)
    if choose:
        nested, sound = nested_rss(gram)  # the candidates are nested: one elimination serves all of them
        for lags in range(int(top.max()) + 1):
            asked = np.flatnonzero(lags <= top)
            rows = m[asked] - 1 - top[asked]
            rss, left = nested[asked, fixed + lags], np.flatnonzero(~sound[asked, fixed + lags])
            if len(left):
                rss[left] = solve_many(part(gram[asked[left]], lags), rows[left])[2]
            score = rows * np.log(np.maximum(rss / rows, 1e-300)) + 2 * (fixed + 1 + lags)
            better = score < best[asked] - 1e-12
            best[asked[better]], used[asked[better]] = score[better], lags
    stat = np.full(len(m), np.nan)
    for lags in np.unique(used).tolist():
        mine = np.flatnonzero(used == lags)
        small, first, length = part(gram[mine], lags), h[mine], m[mine]
        # the equations the common sample left out come from the first values of the series
        for t in range(lags + 1, int(top[mine].max()) + 1):
            row = _design([first[:, t - 1 - j] for j in range(lags + 1)], first[:, t], t / length, base)
            row = np.stack([np.broadcast_to(x, len(mine)) for x in row], axis=1)
            row = np.where(((t <= top[mine]) & (t < known[mine]))[:, None], row, 0.0)
            small = small + row[:, :, None] * row[:, None, :]
        beta, se, rss = solve_many(small, length - 1 - lags)
        usable = (se[:, fixed] > 1e-300) & (rss > 0)
        stat[mine] = np.where(usable, beta[:, fixed] / np.where(usable, se[:, fixed], 1.0), np.nan)
    return stat, used


def _adf_solver(base: str, limit: int, choose: bool):
    size = FIXED[base] + 1 + limit + 1

    def solver(upper: pd.Series, head: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"stat": pd.Series([None] * len(n), dtype=object), "lags": pd.Series([None] * len(n), dtype=object)})
        long = np.flatnonzero(n.to_numpy() >= 4)
        if len(long):
            h, known = np.zeros((len(long), limit + 2)), head.iloc[long].map(len).to_numpy()
            for i, values in enumerate(head.iloc[long]):
                h[i, :len(values)] = values
            stat, used = _adf_stats(squares(upper.iloc[long], size), h, known, n.to_numpy()[long].astype(np.int64), base, limit, choose)
            out.loc[long, "stat"] = [None if math.isnan(v) else v for v in stat.tolist()]
            out.loc[long, "lags"] = used.tolist()
        return out

    return F.pandas_udf(solver, ADF_RESULT)


def _read_off(merged: DataFrame, by, regression: str, limit: int, choose: bool, tests=("adf", "kpss")) -> DataFrame:
    """Statistics and verdicts of the tests named, a row per group and ``d``."""
    out, shown = merged, [*by, "d"]
    if "adf" in tests:
        out = out.withColumn("r", _adf_solver(regression, limit, choose)("g", "v", "n"))
        one, five, ten = ADF_CRITICAL[regression]
        stat = F.col("r.stat")
        shown += [stat.alias("adf_stat"), F.col("r.lags").alias("adf_lags"),
                  F.when(stat < one, "1%").when(stat < five, "5%").when(stat < ten, "10%").otherwise("none").alias("adf_level"),
                  F.coalesce(stat < five, F.lit(False)).alias("adf_stationary")]
    if "kpss" in tests:
        one, five, ten = KPSS_CRITICAL[regression]
        k = F.col("_k")
        out = out.withColumn("_k", F.when(F.col("known") > 0, F.col("walk2") / (F.col("n").cast("double") * F.col("n") * F.col("lrv"))))
        p = F.when(k < ten, 0.1).when(k < five, 0.05).when(k < one, 0.01).otherwise(0.001)
        shown += [k.alias("kpss_stat"), p.alias("kpss_p"), (k < five).alias("kpss_stationary")]
    return out.select(*shown)


def _tested(s: DataFrame, by, regression: str, max_lags: int | None, values=(VALUE,), tests=("adf", "kpss")) -> DataFrame:
    """The tests of an indexed series and, as ``values`` names them, of its differences: one pass over the rows for all."""
    if "adf" in tests and regression not in ADF_CRITICAL:
        raise ValueError("regression is n, c or ct")
    limit = MAX_LAGS if max_lags is None else max_lags
    level, flat = "adf" in tests and regression != "n", regression == "c"
    totals = {"n": F.count("*")}
    for d, v in enumerate(values):
        if level or flat:
            totals[f"_m{d}"] = F.avg(v)
        if "kpss" in tests and not flat:
            at = F.when(F.col(v).isNotNull(), F.col(IDX) - d)
            totals |= {f"_b{d}": F.regr_slope(v, at), f"_a{d}": F.regr_intercept(v, at)}
    s = layout.with_totals(s.select(*layout.keys(s, by), IDX, *values), by, **totals)
    columns, levels, residuals = {}, [], []
    for d, v in enumerate(values):
        if level or flat:
            columns[f"_c{d}"] = F.col(v) - F.col(f"_m{d}")
        if "adf" in tests:
            levels.append(v if regression == "n" else f"_c{d}")
        if "kpss" in tests:
            line = F.col(f"_a{d}") + F.col(f"_b{d}") * (F.col(IDX) - d) if not flat else None
            if not flat:
                columns[f"_e{d}"] = F.col(v) - F.coalesce(line, F.col(v))
            residuals.append(f"_c{d}" if flat else f"_e{d}")
    sums = _sums(s.withColumns(columns), levels, residuals, by, regression if levels else "n", limit if levels else 0)
    merged = _merged(sums, by, layout.has_chunks(s), FIXED[regression] + 2 + limit if levels else 0)
    return _read_off(merged, by, regression, limit, max_lags is None, tests)


def adf_test(df: DataFrame, regression: str = "c", max_lags: int | None = None, by=BY,
             bounded: bool = False) -> DataFrame:
    """Augmented Dickey-Fuller t-statistic of the level; lags by AIC unless ``max_lags`` is given.

    All lag candidates are nested, so one pass of product sums serves lag choice and test.
    """
    return _tested(layout.with_index(df, by, bounded=bounded), by, regression, max_lags, tests=("adf",)).drop("d")


def adf_lag_select(df: DataFrame, regression: str = "c", by=BY, bounded: bool = False) -> DataFrame:
    return adf_test(df, regression, None, by, bounded).select(*by, "adf_lags")


def long_run_variance(e: DataFrame, value: str, by=BY) -> DataFrame:
    """Bartlett-weighted sum of autocovariances of an indexed residual column, floor 1e-10."""
    limit = max(1, int(_newey_west_lags(np.array([max(layout.longest(e, by), 1)]))[0]))
    rows = layout.with_lags(e.select(*layout.keys(e, by), IDX, F.col(value).alias("_e")), "_e", limit, by)
    sums = [F.coalesce(F.sum(F.col("_e") * F.col(f"lag_{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, limit + 1)]
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("s0"), *sums)
    depth = F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9.0))), F.floor(F.col("n") / 4))
    total = F.col("s0")
    for k in range(1, limit + 1):
        total = total + F.when(depth >= k, 2.0 * (1.0 - k / (depth + 1.0)) * F.col(f"s{k}")).otherwise(0.0)
    return g.select(*by, "n", F.greatest(total / F.col("n"), F.lit(1e-10)).alias("lrv"))


def _residuals(df: DataFrame, regression: str, by, bounded) -> DataFrame:
    s = layout.with_index(df, by, bounded=bounded)
    if regression == "c":
        s = layout.with_totals(s, by, _m=F.avg(VALUE))
        return s.withColumn("_e", F.col(VALUE) - F.col("_m"))
    s = layout.with_totals(s, by, _b=F.regr_slope(VALUE, IDX), _a=F.regr_intercept(VALUE, IDX))
    return s.withColumn("_e", F.col(VALUE) - F.coalesce(F.col("_a") + F.col("_b") * F.col(IDX), F.col(VALUE)))


def kpss_test(df: DataFrame, regression: str = "c", by=BY, bounded: bool = False) -> DataFrame:
    """Partial sums of the demeaned (or detrended) series against the long-run variance."""
    return _tested(layout.with_index(df, by, bounded=bounded), by, regression, None, tests=("kpss",)).drop("d")


def stationarity(df: DataFrame, regression: str = "c", max_lags: int | None = None, by=BY,
                 bounded: bool = False) -> DataFrame:
    """Both tests side by side; stationary only if both say so."""
    both = _tested(layout.with_index(df, by, bounded=bounded), by, regression, max_lags).drop("d")
    return both.withColumn("is_stationary", F.col("adf_stationary") & F.col("kpss_stationary"))


def choose_d(df: DataFrame, d_max: int = 2, regression: str = "c", by=BY, bounded: bool = False, max_lags: int | None = None) -> DataFrame:
    """Smallest d whose differenced series passes both tests, else ``d_max``: all d in one pass over the rows."""
    s, values = difference_columns(layout.with_index(df, by, bounded=bounded), d_max, by)
    tests = _tested(s, by, regression, max_lags, values)
    passed = F.col("adf_stationary") & F.col("kpss_stationary")
    return tests.groupBy(*by).agg(F.coalesce(F.min(F.when(passed, F.col("d"))), F.lit(d_max)).cast("long").alias("d"))


def roots_outside(coefs: Column) -> Column:
    """Are all roots of 1 - c1 z - ... - cp z^p outside the unit circle?

    Step-down recursion: every reflection coefficient of the polynomial has to be below one.
    """
    start = F.struct(coefs.alias("c"), F.lit(True).alias("ok"))

    def step(state, _):
        last = F.element_at(state["c"], -1)
        rest = F.slice(state["c"], F.lit(1), F.size(state["c"]) - 1)
        return let(last, F.struct(rest.alias("c"), state["ok"]), lambda s, k: F.struct(
            F.zip_with(s["c"], F.reverse(s["c"]), lambda a, b: div(a + k * b, 1.0 - k * k)).alias("c"),
            (s["ok"] & (F.abs(k) < 1.0)).alias("ok")))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(coefs), F.lit(1))), start, step)
    return F.when(F.size(coefs) == 0, True).otherwise(F.coalesce(folded["ok"], F.lit(False)))


def check_stationary_roots(fits: DataFrame, phi: str = "phi") -> DataFrame:
    return fits.withColumn("is_stationary", roots_outside(F.col(phi)))


def check_invertible_roots(fits: DataFrame, theta: str = "theta") -> DataFrame:
    return fits.withColumn("is_invertible", roots_outside(F.transform(theta, lambda x: -x)))
