"""Sources, sinks, column heuristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import layout
from tidemark.layout import IDX, SERIES, TIME, VALUE
from tidemark.plans.queries.common import query, r
from tidemark.plans.series import COO, EMBEDDING_SIZE, HOURLY, USER
from tidemark.sources import files, ingest

ORDER_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderdate"]
ORDERS_SQL = f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, o_orderdate FROM orders"


def _orders_csv(t):
    path = layout.scratch_path(t.spark, "orders")
    return files.write_csv(t("orders").select(*ORDER_COLUMNS), path)


@query("read_csv", ORDERS_SQL)
def read_csv(t):
    schema = "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz"
    return files.read_csv(t.spark, _orders_csv(t), schema)


@query("write_csv", ORDERS_SQL)
def write_csv(t):
    back = files.read_csv(t.spark, _orders_csv(t))
    return back.select(F.col("o_orderkey").try_cast("long").alias("o_orderkey"),
                       F.col("o_totalprice").try_cast("double").alias("o_totalprice"),
                       ingest.parse_timestamp(F.col("o_orderdate")).alias("o_orderdate"))


@query("write_parquet", ORDERS_SQL.replace("FROM", ", o_orderpriority FROM"))
def write_parquet(t):
    path = layout.scratch_path(t.spark, "orders")
    files.write_parquet(t("orders").select(*ORDER_COLUMNS, "o_orderpriority"), path, ["o_orderpriority"])
    return t.spark.read.parquet(path)


@query("read_parquet_column", f"SELECT {r('o_totalprice')} AS o_totalprice FROM orders WHERE o_totalprice IS NOT NULL")
def read_parquet_column(t):
    return files.read_parquet_column(t.spark, t.path("orders"), "o_totalprice")


@query("read_csv_column", f"SELECT o_orderdate::VARCHAR AS o_orderdate, {r('o_totalprice')} AS o_totalprice FROM orders")
def read_csv_column(t):
    d = files.read_csv_column(t.spark, _orders_csv(t), "o_totalprice", "o_orderdate")
    return d.withColumn("o_orderdate", ingest.parse_timestamp(F.col("o_orderdate")).cast("string"))


@query("to_ordered_vector", USER + f"SELECT series_id, idx, {r('y')} AS y FROM s")
def to_ordered_vector(t):
    v = ingest.to_ordered_vector(t.ev_user())
    return v.select(SERIES, F.posexplode("values").alias(IDX, VALUE))


@query("matrix_to_coo", COO + f"SELECT row, col::BIGINT AS col, {r('value')} AS value FROM m")
def matrix_to_coo(t):
    return t.matrix()


@query("coo_to_rows", "SELECT vec_id AS row, " + ", ".join(
    f"{r(f'embedding[{j + 1}]::DOUBLE')} AS c{j}" for j in range(EMBEDDING_SIZE)) + " FROM embeddings")
def coo_to_rows(t):
    return ingest.coo_to_rows(t.matrix(), EMBEDDING_SIZE)


def _suggestions(t, suggest):
    rows = []
    for name in ("events", "orders", "lineitem", "nation", "labels"):
        found = suggest(t(name))
        rows += [(name, c) for c in ([found] if isinstance(found, str) else found or [])]
    return t.spark.createDataFrame(rows, "table_name string, column_name string")


def _columns_sql(condition: str, first: bool) -> str:
    parts = []
    for name in ("events", "orders", "lineitem", "nation", "labels"):
        limit = " LIMIT 1" if first else ""
        parts.append(f"(SELECT '{name}' AS table_name, column_name FROM (DESCRIBE SELECT * FROM {name}) "
                     f"WHERE {condition}{limit})")
    return " UNION ALL ".join(parts)


@query("suggest_datetime_column", _columns_sql(
    "column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' OR lower(column_name) LIKE '%date%' "
    "OR lower(column_name) LIKE '%time%'", True))
def suggest_datetime_column(t):
    return _suggestions(t, ingest.suggest_datetime_column)


@query("suggest_numeric_columns", _columns_sql("column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT')", False))
def suggest_numeric_columns(t):
    return _suggestions(t, ingest.suggest_numeric_columns)


@query("parse_numeric", f"""SELECT o_orderkey, '$' || format('{{:,.2f}}', o_totalprice) AS money,
{r("try_cast(replace(replace('$' || format('{:,.2f}', o_totalprice), '$', ''), ',', '') AS DOUBLE)")} AS value FROM orders""")
def parse_numeric(t):
    return t.money().withColumn("value", ingest.parse_numeric(F.col("money")))


@query("parse_timestamp", """SELECT event_id, date_trunc('second', ts) AS t,
try_cast(props AS TIMESTAMP) IS NULL AS bad_is_null FROM events""")
def parse_timestamp(t):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t("events").select("event_id", ingest.parse_timestamp(text, "yyyy-MM-dd HH:mm:ss").alias("t"),
                              ingest.parse_timestamp(F.col("props")).isNull().alias("bad_is_null"))


@query("pick_value_column", f"SELECT {r('value')} AS value FROM events")
def pick_value_column(t):
    d = t("events")
    return d.select(ingest.pick_value_column(d))


@query("check_schema", """SELECT false AS is_valid, 'Missing required columns: volume' AS issues,
'Value column event_type should be numeric' AS warnings, count(*) AS row_count FROM events""")
def check_schema(t):
    report = ingest.check_schema(t("events"), ["ts", "volume"], "event_type")
    return report.withColumns({c: F.array_join(c, "; ") for c in ("issues", "warnings")})


@query("profile_frame", "SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem")
def profile_frame(t):
    return ingest.profile_frame(t("lineitem")).drop("partitions")


@query("sample_rows", f"""SELECT event_id, {r('value')} AS value FROM events
WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT < CAST(floor(0.1 * 16777215) AS BIGINT)""")
def sample_rows(t):
    return ingest.sample_rows(t("events"), 0.1, "event_id").select("event_id", "value")


@query("sample_series", HOURLY + f"""
SELECT series_id, t, {r('y')} AS y FROM s
WHERE ('0x' || substr(md5(series_id), 1, 6))::BIGINT < CAST(floor(0.5 * 16777215) AS BIGINT)""")
def sample_series(t):
    return ingest.sample_series(t.ev_hourly(), 0.5).select(SERIES, TIME, VALUE)
