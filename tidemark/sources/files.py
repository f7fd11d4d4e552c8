"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.guards import clean


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header.  Without a schema every column stays a string: no inference pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def _usable(df: DataFrame, column: str, order, rows: int | None) -> DataFrame:
    out = (df.select(*([order] if order else []), clean(F.col(column).try_cast("double")).alias(column))
           .filter(F.col(column).isNotNull()))
    if rows is None:
        return out
    if order is None:
        raise ValueError("a row limit needs an order, or the rows would be arbitrary")
    return out.orderBy(order, column).limit(rows)


def read_parquet_column(spark: SparkSession, path: str, column: str, order: str | None = None,
                        rows: int | None = None) -> DataFrame:
    """One numeric column of a Parquet table; unusable values dropped; at most ``rows`` when asked for."""
    return _usable(spark.read.parquet(path), column, order, rows)


def read_csv_column(spark: SparkSession, path: str, column: str, order: str | None = None,
                    rows: int | None = None) -> DataFrame:
    return _usable(read_csv(spark, path), column, order, rows)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("error").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by=()) -> str:
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
