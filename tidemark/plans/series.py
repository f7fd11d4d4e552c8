"""Series carved out of the star-schema tables; every function takes a reader of tables by name.

Hour, day and month grids bound a series by the calendar (``bounded=True`` downstream).  Per-user
series have no such bound and are measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.sources import ingest


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def ev_hourly(self) -> DataFrame:
        """Mean event value per type and hour; hours without events are absent."""
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return self("events").groupBy(F.col("event_type").alias(SERIES), hour.alias(TIME)).agg(
            F.avg("value").alias(VALUE))

    def hourly(self) -> DataFrame:
        return layout.with_index(self.ev_hourly(), bounded=True)

    def ev_user(self) -> DataFrame:
        """Raw event values per user in time order."""
        e = self("events").select(F.col("user_id").cast("string").alias(SERIES), F.col("ts").alias(TIME),
                                  "event_id", F.col("value").alias(VALUE))
        return layout.with_index(e, order=(TIME, "event_id")).drop("event_id")

    def ord_daily(self) -> DataFrame:
        """Daily order value in thousands per priority."""
        return self("orders").groupBy(F.col("o_orderpriority").alias(SERIES), F.col("o_orderdate").alias(TIME)).agg(
            (F.sum("o_totalprice") / 1000.0).alias(VALUE))

    def daily(self) -> DataFrame:
        return layout.with_index(self.ord_daily(), bounded=True)

    def _revenue(self):
        return (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000.0).alias(VALUE)

    def li_monthly(self) -> DataFrame:
        month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
        return self("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias(SERIES),
                                        month.alias(TIME)).agg(self._revenue())

    def monthly(self) -> DataFrame:
        return layout.with_index(self.li_monthly(), bounded=True)

    def li_daily(self) -> DataFrame:
        """One long series: daily revenue in thousands."""
        daily = self("lineitem").groupBy(F.col("l_shipdate").alias(TIME)).agg(self._revenue())
        return daily.select(F.lit("all").alias(SERIES), TIME, VALUE)

    def revenue(self) -> DataFrame:
        return layout.with_index(self.li_daily(), bounded=True)

    def dirty(self) -> DataFrame:
        """The hourly series on the full hour grid: hours without events are NULL."""
        seen = self.ev_hourly()
        hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
        span = Window.partitionBy(F.lit(1))
        ends = (self("events").groupBy(F.col("event_type").alias(SERIES))
                .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
                .select(SERIES, hour(F.min("lo").over(span)).alias("lo"), hour(F.max("hi").over(span)).alias("hi")))
        every = ends.select(SERIES, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(TIME))
        return layout.with_index(every.join(seen, [SERIES, TIME], "left").select(SERIES, TIME, VALUE), bounded=True)

    def matrix(self) -> DataFrame:
        return ingest.matrix_to_coo(self("embeddings"), "vec_id", "embedding")

    def money(self) -> DataFrame:
        return self("orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("money"))



EMBEDDING_SIZE = 64


def positions(rows: DataFrame) -> DataFrame:
    return rows.select(SERIES, IDX, VALUE)


def indexed_sql(base: str) -> str:
    """``s``: the series of ``base`` with position and length; ``c``: centred."""
    return f"""WITH base AS ({base}),
s AS (SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx,
             count(*) OVER (PARTITION BY series_id) AS n FROM base),
c AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS w, avg(y) OVER (PARTITION BY series_id) AS mean FROM s)"""


HOURLY_BASE = ("SELECT event_type AS series_id, date_trunc('hour', ts) AS t, avg(value) AS y "
               "FROM events GROUP BY 1, 2")
DAILY_BASE = ("SELECT o_orderpriority AS series_id, o_orderdate AS t, sum(o_totalprice) / 1000.0 AS y "
              "FROM orders GROUP BY 1, 2")
MONTHLY_BASE = ("SELECT l_returnflag || l_linestatus AS series_id, date_trunc('month', l_shipdate)::TIMESTAMP AS t, "
                "sum(l_extendedprice * (1 - l_discount)) / 1000.0 AS y FROM lineitem GROUP BY 1, 2")
REVENUE_BASE = ("SELECT 'all' AS series_id, l_shipdate AS t, sum(l_extendedprice * (1 - l_discount)) / 1000.0 AS y "
                "FROM lineitem GROUP BY 2")
DIRTY_BASE = f"""SELECT g.series_id, g.t, h.y FROM
(SELECT e.series_id, t FROM (SELECT DISTINCT event_type AS series_id FROM events) e,
 (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events)) g
LEFT JOIN ({HOURLY_BASE}) h ON g.series_id = h.series_id AND g.t = h.t"""
USER_BASE = "SELECT user_id::VARCHAR AS series_id, ts AS t, value AS y, event_id FROM events"

HOURLY, DAILY, MONTHLY = indexed_sql(HOURLY_BASE), indexed_sql(DAILY_BASE), indexed_sql(MONTHLY_BASE)
REVENUE, DIRTY = indexed_sql(REVENUE_BASE), indexed_sql(DIRTY_BASE)
USER = indexed_sql(USER_BASE).replace("ORDER BY t)", "ORDER BY t, event_id)")
COO = """WITH m AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, unnest(embedding)::DOUBLE AS value FROM embeddings)"""
