"""Vectors, coordinate matrices, correlations between columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions.guards import div
from tidemark.layout import BY, IDX, SERIES, TIME, VALUE


SALT = 32


def dot_product(a: DataFrame, b: DataFrame, by=BY) -> DataFrame:
    """Sum of products of values at equal positions; the join key carries the position, so it spreads."""
    left = a.select(*by, IDX, F.col(VALUE).alias("_a"))
    right = b.select(*by, IDX, F.col(VALUE).alias("_b"))
    return left.join(right, [*by, IDX]).groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def sum_squares(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.col(VALUE) * F.col(VALUE)), F.lit(0.0)).alias("sum_squares"))


def vector_mean(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(VALUE), F.lit(0.0)).alias("mean"))


def vector_variance(df: DataFrame, mean: float | None = None, by=BY) -> DataFrame:
    """Population variance, around a given mean when one is passed."""
    y = F.col(VALUE)
    v = F.var_pop(y) if mean is None else F.avg((y - mean) * (y - mean))
    return df.groupBy(*by).agg(F.coalesce(v, F.lit(0.0)).alias("variance"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Coordinate matrix times ``(idx, y)``; a column's one vector value is copied for ``SALT`` groups of rows.

    A matrix of few columns has few join keys; the row number spreads each of them.
    """
    v = vector.select(F.col(IDX).alias("col"), F.col(VALUE).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    m = matrix.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    return (m.join(v, ["col", "_salt"]).groupBy("row")
            .agg(F.sum(F.col("value") * F.col("_v")).alias("value")))


TILE = 256
#: Tiles along the shared dimension that one task sums before its cells leave.
SLAB = 64


def _tiles(m: DataFrame, outer: str, inner: str, names: tuple[str, str]) -> DataFrame:
    """Tiles of ``TILE`` by ``TILE``: their numbers, and three arrays of local positions and values."""
    local = lambda c: F.pmod(F.col(c), F.lit(TILE)).cast("int")
    tile = lambda c: F.expr(f"({c} - pmod({c}, {TILE}L)) div {TILE}")
    cells = m.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value"))  # repeated coordinates add up
    cells = cells.select(tile(outer).alias(names[0]), tile(inner).alias("_k"), F.struct(
        local("row").alias("r"), local("col").alias("c"), F.col("value").alias("v")).alias("s"))
    tiles = cells.groupBy(names[0], "_k").agg(F.collect_list("s").alias("s"))
    side = names[1]
    return tiles.select(names[0], "_k", *[F.col(f"s.{c}").alias(f"{side}{c}") for c in "rcv"])


def _multiplied(size: int):
    """Cells of the products of tile pairs, summed over runs of equal (_i, _j); rows come sorted by these."""
    def run(batches):
        key, held, found = None, None, None

        def cells():
            some = np.nonzero(found[0])
            value = np.where(found[1][some] > 0, held[some], np.nan)
            return pd.DataFrame({"row": key[0] * size + some[0], "col": key[1] * size + some[1], "value": value})

        def dense(r, c, v):
            out, seen, known = np.zeros((size, size)), np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
            v = np.asarray(v, dtype=float)
            out[r, c], seen[r, c], known[r, c] = np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf), 1.0, ~np.isnan(v)
            return out, seen, known

        for batch in batches:
            for t in batch.itertuples(index=False):
                here = (int(t._0), int(t._1))
                if here != key:
                    if key is not None:
                        yield cells()
                    key, held, found = here, np.zeros((size, size)), [np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)]
                (a, sa, ka), (b, sb, kb) = dense(t.ar, t.ac, t.av), dense(t.br, t.bc, t.bv)
                held += a @ b
                found[0] += sa @ sb
                found[1] += ka @ kb
        if key is not None:
            yield cells()

    return run


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of coordinate matrices; a cell is there where a row and a column share a position.

    Tiles are joined, not cells: two tiles of a shared key make one dense product in a task, and ``SLAB`` of them are summed
    before their cells leave it.  So the rows before the last sum are the cells of the result, once per ``TILE * SLAB`` shared positions.
    """
    left, right = _tiles(a, "row", "col", ("_i", "a")), _tiles(b, "col", "row", ("_j", "b"))
    pairs = left.join(right, "_k").withColumn("_slab", F.expr(f"_k div {SLAB}"))
    names = ["_i", "_j", "ar", "ac", "av", "br", "bc", "bv"]
    placed = pairs.repartition("_i", "_j", "_slab").sortWithinPartitions("_i", "_j").select(names)
    cells = placed.mapInPandas(_multiplied(TILE), "row long, col long, value double")
    # a cell without any known product has no value, as a sum of nulls has none
    return cells.groupBy("row", "col").agg(F.sum(F.nanvl("value", F.lit(None).cast("double"))).alias("value"))


def lag_join(df: DataFrame, lag: int, by=BY) -> DataFrame:
    """Rows next to the row ``lag`` positions earlier, as a join; any lag length, nothing ordered."""
    earlier = df.select(*by, (F.col(IDX) + lag).alias(IDX), F.col(VALUE).alias("y_lag"))
    return df.select(*by, IDX, VALUE).join(earlier, [*by, IDX])


def cross_correlation(df: DataFrame, x: str, y: str, max_lags: int, by=BY, bounded: bool = False) -> DataFrame:
    """Lags -K..K of two columns of one indexed table, all of them in one window pass."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, _n=F.count("*"), _mx=F.avg(x),
                           _my=F.avg(y), _sx=F.stddev_pop(x), _sy=F.stddev_pop(y))
    s = s.withColumn("_x", F.col(x) - F.col("_mx")).withColumn("_y", F.col(y) - F.col("_my"))
    rows, w, finish = layout.neighbourhood(s, max_lags, max_lags, by)
    shifted = lambda k: F.lag("_y", k).over(w) if k >= 0 else F.lead("_y", -k).over(w)
    name = lambda k: f"_k{k + max_lags}"
    lags = range(-max_lags, max_lags + 1)
    rows = finish(rows.withColumns({name(k): shifted(k) for k in lags}))
    g = rows.groupBy(*by).agg(F.max("_sx").alias("_sx"), F.max("_sy").alias("_sy"),
                              *[F.avg(F.col("_x") * F.col(name(k))).alias(name(k)) for k in lags])
    value = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.coalesce(
        div(F.col(name(k)), F.col("_sx") * F.col("_sy")), F.lit(0.0)).alias("ccf")) for k in lags])
    return g.select(*by, F.explode(value).alias("s")).select(*by, "s.lag", "s.ccf")


def seasonal_join(df: DataFrame, period: int, by=BY, bounded: bool = False) -> DataFrame:
    """The mean of each phase next to every row."""
    s = layout.with_index(df, by, bounded=bounded).withColumn("phase", F.pmod(IDX, F.lit(period)))
    return layout.with_totals(s, (*by, "phase"), seasonal=F.avg(VALUE))


def task_grid(windows: DataFrame, orders) -> DataFrame:
    """Every window with every ``(p, d, q)``: the order list is a literal, so rows expand without a join."""
    grid = F.array(*[F.struct(*[F.lit(int(v)).alias(n) for n, v in zip("pdq", o)]) for o in orders])
    return windows.withColumn("_o", F.explode(grid)).select(*windows.columns, "_o.p", "_o.d", "_o.q")


def align(a: DataFrame, b: DataFrame, left: str, right: str, by=BY) -> DataFrame:
    """Pair two step tables by ``(series, step)``; unmatched steps drop out."""
    return (a.select(*by, "step", F.col("forecast").alias(left))
            .join(b.select(*by, "step", F.col("forecast").alias(right)), [*by, "step"]))


def align_forecasts(a: DataFrame, b: DataFrame, by=BY) -> DataFrame:
    return align(a, b, "forecast_a", "forecast_b", by)


def align_actual(actual: DataFrame, forecast: DataFrame, by=BY) -> DataFrame:
    """``actual`` has ``(series, step, actual)``."""
    return actual.select(*by, "step", "actual").join(
        forecast.select(*by, "step", F.col("forecast").alias("predicted")), [*by, "step"])


def _local_runs(batches):
    """Rows of one sorted partition with the first and last place of their run of equal values in it.

    The last run of a batch waits for its end; of that, row numbers are held.
    """
    value, rows, first, at = None, [], 0, 0
    differ = lambda a, b: (a != b) & ~((a != a) & (b != b))  # no value is equal to no value

    def table(ids, start, end, values, last_run=False):
        return pd.DataFrame({"_row": ids, "_from": start, "_to": end, "_value": values, "_opens": start == 0, "_closes": last_run})

    def held(last_run):
        ids = np.concatenate(rows)
        return table(ids, np.full(len(ids), first), at - 1, np.full(len(ids), value), last_run)

    for batch in batches:
        values, ids = batch["_value"].to_numpy(), batch["_row"].to_numpy()
        if not len(ids):
            continue
        edges = np.concatenate([[0], np.flatnonzero(differ(values[1:], values[:-1])) + 1, [len(ids)]])
        done = []
        if rows and not differ(values[0], value):  # the run goes on
            rows.append(ids[:edges[1]])
            at += edges[1]
            ids, values, edges = ids[edges[1]:], values[edges[1]:], edges[1:] - edges[1]
        if not len(ids):
            continue
        if rows:
            done.append(held(False))
        sizes = np.diff(edges)[:-1]
        inner = int(edges[-2])
        if inner:
            done.append(table(ids[:inner], at + np.repeat(edges[:-2], sizes), at + np.repeat(edges[1:-1], sizes) - 1, values[:inner]))
        value, rows, first, at = values[inner], [ids[inner:]], at + inner, at + len(ids)
        if done:
            yield pd.concat(done, ignore_index=True)
    if rows:
        yield held(True)


def average_ranks(df: DataFrame, column: str, row: str) -> DataFrame:
    """``row, rank_column``: the average rank of the row's value, ties sharing it; rows without a value have none.

    One range sort by value and row, so that a frequent value may lie in many partitions.  A run of ties that
    crosses partition edges is closed by a table with the first and the last run of each partition.
    """
    present = df.filter(F.col(column).isNotNull()).select(F.col(row).alias("_row"), F.col(column).alias("_value"))
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()),
                           T.StructField("_value", present.schema["_value"].dataType), T.StructField("_opens", T.BooleanType()),
                           T.StructField("_closes", T.BooleanType())])
    sorted_rows = present.repartitionByRange("_value", "_row").sortWithinPartitions("_value", "_row")
    # written once: range bounds come from a sample, and the edge table and the rows have to see the same partitions
    placed = layout.durable(sorted_rows.mapInPandas(_local_runs, schema).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg((F.max("_to") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    edges = (placed.filter("_opens OR _closes").groupBy("_part", "_value", "_from", "_to").agg(F.lit(1).alias("_one"))
             .join(starts, "_part"))
    whole = edges.groupBy("_value").agg(F.min(F.col("_before") + F.col("_from")).alias("_first"), F.max(F.col("_before") + F.col("_to")).alias("_last"))
    closed = edges.join(whole, edges["_value"].eqNullSafe(whole["_value"])).select("_part", "_from", "_first", "_last")
    out = placed.join(starts, "_part").join(closed, ["_part", "_from"], "left")
    first = F.coalesce("_first", F.col("_before") + F.col("_from"))
    last = F.coalesce("_last", F.col("_before") + F.col("_to"))
    return out.select(F.col("_row").alias(row), ((first + last) / 2.0 + 1.0).alias(f"rank_{column}"))


def correlation_matrix(df: DataFrame, columns, method: str = "pearson") -> DataFrame:
    """``(var_a, var_b, corr)`` from one aggregate; constant columns give NULL instead of failing."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method is pearson or spearman")
    data, names = df.select(*columns), list(columns)
    if method == "spearman":
        rows = layout.durable(data.withColumn("_row", F.monotonically_increasing_id()))
        data = rows.select("_row")
        for c in columns:
            data = data.join(average_ranks(rows, c, "_row"), "_row", "left")
        names = [f"rank_{c}" for c in columns]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs = []
    for i, j in pairs:  # moments over the rows that have both values
        x, y = F.col(names[i]).cast("double"), F.col(names[j]).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        aggs += [F.covar_pop(x, y).alias(f"c{i}_{j}"), F.var_pop(x).alias(f"a{i}_{j}"), F.var_pop(y).alias(f"b{i}_{j}")]
    g = data.agg(*aggs)

    def cell(i, j):
        at = f"{min(i, j)}_{max(i, j)}"
        spread = F.sqrt(F.greatest(F.col(f"a{at}"), F.lit(0.0))) * F.sqrt(F.greatest(F.col(f"b{at}"), F.lit(0.0)))
        return F.struct(F.lit(columns[i]).alias("var_a"), F.lit(columns[j]).alias("var_b"), div(F.col(f"c{at}"), spread).alias("corr"))
    cells = [cell(i, j) for i in range(len(names)) for j in range(len(names))]
    return g.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
