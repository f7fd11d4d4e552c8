"""How series are laid out over tasks.

Every operator works on a long table ``(series_id, t, y)``.  ``with_index`` adds ``idx``, the dense
0-based position inside a series.  Two layouts exist, told apart by the columns alone:

* *whole*: no ``chunk`` column.  Every series was measured (or is known by construction) to be short
  enough for one task, so ordered windows partition by the series key.
* *chunked*: a ``chunk`` column (``idx div chunk_rows``).  One series may hold a large share of all
  rows, so no task ever sees a whole series.  Windows partition by series **and** chunk; rows near a
  chunk edge are copied to the neighbour (``neighbourhood``), and what has to travel further than
  that (totals, running sums, carried values) goes through one small row per chunk.

The helpers below hide the difference, so operators are written once.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES, TIME, VALUE, IDX, CHUNK = "series_id", "t", "y", "idx", "chunk"
BY = (SERIES,)

CHUNK_ROWS_CONF = "spark.tidemark.chunkRows"
WHOLE_ROWS_CONF = "spark.tidemark.wholeSeriesRows"


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, "65536"))


def whole_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(WHOLE_ROWS_CONF, "1000000"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the folder that driver and executors share.

    That is ``spark.checkpoint.dir`` or, where it is unset, Spark's own ``spark.sql.warehouse.dir``.  On a cluster a plain
    local path is refused as such a default: every executor would write to its own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.conf.get("spark.master", "local").startswith("local")
        if not local and urlparse(shared).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Unlike a checkpointed plan the table starts without inherited constraints and with its real size,
    so repeated rounds plan in constant time and small tables are broadcast.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """New column identities, so that two tables of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def for_tasks(df: DataFrame, by) -> DataFrame:
    """Hash the groups over a fixed number of tasks before heavy per-group work.

    Adaptive execution sizes partitions by bytes; a few megabytes of series can be minutes of fitting.
    Hashing a hash keeps this from being dropped as a repeat of an earlier, since coalesced, exchange.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(*by))


HEADER = -1  # position of the row that carries a group's parameters


def map_groups(rows: DataFrame, headers: DataFrame, by, each, schema: T.StructType) -> DataFrame:
    """``each(groups)`` -> frame, for the groups that end in one batch: ``(key, header, columns)`` of each, ordered by position.

    ``headers`` has one row of parameters per group; it travels as a row before the first position.
    Partitions are sorted by group and read as a stream, so there is no per-group call between the JVM
    and Python, no frame per group, and no more than one batch and one group in memory.  ``columns`` are arrays by name; ``header``
    or ``columns`` is None where a side lacks the group.
    """
    extra = [f for f in headers.schema.fields if f.name not in by]
    own = [f for f in rows.schema.fields if f.name not in by and f.name != IDX]
    head = headers.select(*by, F.lit(HEADER).cast("long").alias(IDX), *[F.lit(None).cast(f.dataType).alias(f.name) for f in own],
                          *[F.col(f.name).alias(f"_h_{f.name}") for f in extra])
    data = rows.select(*by, IDX, *[f.name for f in own], *[F.lit(None).cast(f.dataType).alias(f"_h_{f.name}") for f in extra])
    together = for_tasks(data.unionByName(head), by).sortWithinPartitions(*by, IDX)
    by, names, params, held = list(by), schema.names, [f.name for f in extra], [IDX, *[f.name for f in own]]

    def closed(key, header, parts):
        if len(parts) > 1:
            parts = [{c: np.concatenate([part[c] for part in parts]) for c in held}]
        return key, header, parts[0] if parts else None

    def run(batches):
        key, header, parts = None, None, []
        for batch in batches:
            n = len(batch)
            if n == 0:
                continue
            ids, columns = [batch[k].to_numpy() for k in by], {c: batch[c].to_numpy() for c in held}
            given = {c: batch[f"_h_{c}"].to_numpy() for c in params}
            new, heads = np.zeros(n, dtype=bool), columns[IDX] == HEADER
            for column in ids:
                new[1:] |= column[1:] != column[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), n]
            done = []
            for a, b in zip(edges[:-1], edges[1:]):
                here = tuple(column[a] for column in ids)
                if here != key and key is not None:
                    done.append(closed(key, header, parts))
                    header, parts = None, []
                key = here
                if heads[a]:
                    header, a = {c: v[a] for c, v in given.items()}, a + 1
                if a < b:
                    parts.append({c: v[a:b] for c, v in columns.items()})
            if done:
                yield each(done)[names]
        if key is not None:
            yield each([closed(key, header, parts)])[names]

    return together.mapInPandas(run, schema)


def has_chunks(df: DataFrame) -> bool:
    return CHUNK in df.columns


def keys(df: DataFrame, by=BY) -> list[str]:
    return [*by, CHUNK] if has_chunks(df) else [*by]


def longest(df: DataFrame, by=BY) -> int:
    """Rows of the longest series: one map-side-combined count over the key columns only."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return row[0] or 0


def needs_chunks(df: DataFrame, by=BY, bounded: bool = False) -> bool:
    """Must this table be split inside its series?  ``bounded`` states a known bound, e.g. a calendar."""
    if has_chunks(df):
        return True
    if IDX in df.columns or bounded:
        return False
    return longest(df, by) > whole_rows(df)


def _tie_breakers(df: DataFrame, used) -> list:
    """Rows of equal time are ordered by a hash of what is left of them, then by the columns themselves.

    Sorting ties by value would put a pattern into the series that is not in the data.
    """
    rest = [f.name for f in df.schema.fields
            if f.name not in used and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.xxhash64(*rest), *rest] if rest else []


def with_index(df: DataFrame, by=BY, order=(TIME,), bounded: bool = False) -> DataFrame:
    """Add ``idx`` (and ``chunk`` where a series is too long for one task)."""
    if IDX in df.columns:
        return df
    ordering = [*order, *_tie_breakers(df, {*by, *order})]
    if not needs_chunks(df, by, bounded):
        w = Window.partitionBy(*by).orderBy(*ordering)
        return df.withColumn(IDX, (F.row_number().over(w) - 1).cast("long"))
    return add_chunk(_index_by_range(df, by, ordering))


def add_chunk(df: DataFrame) -> DataFrame:
    return df.withColumn(CHUNK, F.expr(f"{IDX} div {chunk_rows(df)}"))


def _index_by_range(df: DataFrame, by, ordering) -> DataFrame:
    """Dense positions without a task per series: range sort, then one offset per sorted run.

    The sorted table is written out first: its range bounds come from a sample, so both readers of
    it (the run table and the rows) have to see the same bytes, also after an executor is lost.
    """
    cols = [c if isinstance(c, Column) else F.col(c) for c in (*by, *ordering)]
    placed = durable(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33)))
    runs = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*by, "_part",
                       (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(runs, [*by, "_part"])
            .withColumn(IDX, F.col("_place") + F.col("_shift"))
            .select(*df.columns, IDX))


def neighbourhood(df: DataFrame, back: int = 0, ahead: int = 0, by=BY):
    """Rows with the ``back`` earlier / ``ahead`` later rows their windows need.

    Returns ``(rows, window, finish)``: apply window columns over ``window``, then call ``finish``
    on the result to drop the copies.
    """
    if not has_chunks(df):
        return df, Window.partitionBy(*by).orderBy(IDX), lambda d: d
    size = chunk_rows(df)
    first = F.expr(f"greatest({IDX} - {ahead}, 0L) div {size}")
    last = F.expr(f"({IDX} + {back}) div {size}")
    others = [c for c in df.columns if c != CHUNK]
    rows = df.select(*others, F.col(CHUNK).alias("_home"),
                     F.explode(F.sequence(first, last)).alias(CHUNK))
    w = Window.partitionBy(*by, CHUNK).orderBy(IDX)
    return rows, w, lambda d: d.filter(F.col(CHUNK) == F.col("_home")).drop("_home")


def with_lags(df: DataFrame, value: str, lags: int, by=BY, prefix: str = "lag_") -> DataFrame:
    """``lag_1 .. lag_k`` of one column, all in one window pass."""
    rows, w, finish = neighbourhood(df, back=lags, by=by)
    return finish(rows.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)}))


def chunk_table(df: DataFrame, by=BY, **aggs: Column) -> DataFrame:
    return df.groupBy(*by, CHUNK).agg(*[a.alias(n) for n, a in aggs.items()])


def with_totals(df: DataFrame, by=BY, **aggs: Column) -> DataFrame:
    """Per-series aggregates next to every row."""
    if not has_chunks(df):
        w = Window.partitionBy(*by)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    totals = df.groupBy(*by).agg(F.max(IDX).alias("_last"), *[a.alias(n) for n, a in aggs.items()])
    return spread(df, totals, by)


def spread(df: DataFrame, totals: DataFrame, by=BY) -> DataFrame:
    """Join one row per series to chunked rows on (series, chunk), so that no join key is hot."""
    size = chunk_rows(df)
    per_chunk = (totals
                 .withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {size}"))))
                 .drop("_last"))
    return df.join(per_chunk, [*by, CHUNK])


def join_series(df: DataFrame, per_series: DataFrame, by=BY) -> DataFrame:
    """Rows of a series table joined to a table with one row per series."""
    if not has_chunks(df):
        return df.join(per_series, [*by])
    last = df.groupBy(*by).agg(F.max(IDX).alias("_last"))
    return spread(df, per_series.join(last, [*by]), by)


def with_running_sum(df: DataFrame, out: str, value: Column, by=BY) -> DataFrame:
    d = df.withColumn("_v", value)
    if not has_chunks(d):
        w = Window.partitionBy(*by).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumn(out, F.sum("_v").over(w)).drop("_v")
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (chunk_table(d, by, _s=F.sum("_v"))
               .select(*by, CHUNK, F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_off")))
    w = Window.partitionBy(*by, CHUNK).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(offsets, [*by, CHUNK])
            .withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(w), F.lit(0.0)))
            .drop("_v", "_off"))


def with_carried(df: DataFrame, out: str, value: Column, forward: bool = True, by=BY) -> DataFrame:
    """Nearest non-null ``value`` at or before (``forward``) or at or after each row."""
    d = df.withColumn("_v", value)
    frame = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    pick = F.last if forward else F.first
    local = pick("_v", ignorenulls=True).over(
        Window.partitionBy(*keys(d, by)).orderBy(IDX).rowsBetween(*frame))
    if not has_chunks(d):
        return d.withColumn(out, local).drop("_v")
    seen = F.when(F.col("_v").isNotNull(), F.col(IDX))
    ends = chunk_table(d, by, _e=F.max_by("_v", seen) if forward else F.min_by("_v", seen))
    beyond = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    outside = pick("_e", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(*beyond))
    ends = ends.select(*by, CHUNK, outside.alias("_outside"))
    return (d.join(ends, [*by, CHUNK])
            .withColumn(out, F.coalesce(local, F.col("_outside"))).drop("_v", "_outside"))


def quantiles(df: DataFrame, probabilities, value: str = VALUE, by=BY, bounded: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles: ``(by, q ARRAY<DOUBLE>)``, missing values ignored.

    Short series use the exact percentile aggregate.  That aggregate keeps every distinct value of a
    group in one buffer, so long series are ranked by a range sort and only the ranks asked for are kept.
    """
    present = df.filter(F.col(value).isNotNull())
    if not needs_chunks(df, by, bounded):
        return present.groupBy(*by).agg(
            F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    ranked = _index_by_range(present.select(*by, value), by, [value])
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                      for i, p in enumerate(probabilities)])
    at = F.col("s.p") * (F.col("n") - 1)
    wanted = (present.groupBy(*by).agg(F.count("*").alias("n"))
              .select(*by, "n", F.explode(asked).alias("s"))
              .select(*by, F.col("s.i").alias("i"), F.floor(at).alias("lo"), (at - F.floor(at)).alias("w"))
              .select(*by, "i", F.explode(F.array(
                  F.struct(F.col("lo").alias(IDX), (1 - F.col("w")).alias("w")),
                  F.struct((F.col("lo") + 1).alias(IDX), F.col("w").alias("w")))).alias("s"))
              .select(*by, "i", f"s.{IDX}", "s.w").filter("w > 0"))
    points = (ranked.join(wanted, [*by, IDX]).groupBy(*by, "i")
              .agg(F.sum(F.col("w") * F.col(value)).alias("v")))
    return points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("q")) \
        .withColumn("q", F.transform("q", lambda s: s["v"]))


