"""From arbitrary tables to the series contract ``(series_id, t, y)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.functions.guards import clean
from tidemark.layout import BY, CHUNK, IDX, SERIES, TIME, VALUE

# Words that mark a time column, and preferred value column names.
TIME_WORDS = ("date", "time", "timestamp", "fecha", "tiempo", "datetime")
VALUE_NAMES = ("value", "y", "passengers", "close", "temperature", "sunspots")


def as_series(df: DataFrame, series, time, value) -> DataFrame:
    """Project to ``(series_id STRING, t, y DOUBLE)``; NaN becomes NULL."""
    as_col = lambda c: c if isinstance(c, Column) else F.col(c)
    return df.select(as_col(series).cast("string").alias(SERIES), as_col(time).alias(TIME),
                     clean(as_col(value)).alias(VALUE))


def series_from_values(spark: SparkSession, values, series_id: str = "series") -> DataFrame:
    """A small in-memory sequence as an indexed series; anything but one dimension is refused."""
    shape = getattr(values, "shape", None)
    if shape is not None and len(shape) != 1:
        raise ValueError("a series has exactly one dimension")
    rows = []
    for i, v in enumerate(values):
        if isinstance(v, (list, tuple)):
            raise ValueError("a series has exactly one dimension")
        rows.append((series_id, i, None if v is None else float(v)))
    df = spark.createDataFrame(rows, f"{SERIES} string, {TIME} long, {VALUE} double")
    return df.withColumn(VALUE, clean(F.col(VALUE))).withColumn(IDX, F.col(TIME))


def parse_numeric(text: Column) -> Column:
    """Drop ``$ , %`` and blanks, then cast; what still is no number becomes NULL."""
    return F.trim(F.regexp_replace(text, "[$,%]", "")).try_cast("double")


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else text.try_cast("timestamp_ntz")
    return parsed.cast("timestamp_ntz")


def to_ordered_vector(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Values in time order as arrays of at most ``chunk_rows`` values: one row per series and chunk."""
    s = layout.with_index(df, by, bounded=bounded)
    s = s if layout.has_chunks(s) else layout.add_chunk(s)
    return (s.groupBy(*by, CHUNK)
            .agg(F.array_sort(F.collect_list(F.struct(IDX, VALUE))).alias("v"))
            .select(*by, CHUNK, F.col(f"v.{VALUE}").alias("values")))


def matrix_to_coo(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).alias("row"), F.posexplode(vector).alias("col", "value")) \
        .withColumn("value", F.col("value").cast("double"))


def coo_to_rows(coo: DataFrame, columns: int) -> DataFrame:
    """Dense rows from coordinates; absent cells are 0, repeated cells add up; a cell beyond ``columns`` is an error."""
    beyond = F.raise_error(F.concat(F.lit(f"column beyond {columns}: "), F.col("col").cast("string")))
    checked = coo.withColumn("col", F.when((F.col("col") >= 0) & (F.col("col") < columns), F.col("col")).otherwise(beyond))
    cells = checked.groupBy("row").agg(*[
        F.coalesce(F.sum(F.when(F.col("col") == j, F.col("value"))), F.lit(0.0)).alias(f"c{j}")
        for j in range(columns)])
    return cells


def _probe(df: DataFrame, columns, parse) -> dict[str, bool]:
    """Do all non-null values of each string column parse?  One aggregate over the table for all columns."""
    if not columns:
        return {}
    result = {}
    heads = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]
    good = [F.count(parse(F.col(f"`{c}`"))).alias(f"g{i}") for i, c in enumerate(columns)]
    row = df.agg(*heads, *good).first()
    for i, c in enumerate(columns):
        result[c] = row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"g{i}"]
    return result


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def suggest_datetime_column(df: DataFrame) -> str | None:
    parses = None
    for f in df.schema.fields:
        if any(word in f.name.lower() for word in TIME_WORDS):
            return f.name
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
        if isinstance(f.dataType, T.StringType):
            if parses is None:
                parses = _probe(df, _strings(df), parse_timestamp)
            if parses[f.name]:
                return f.name
    return None


def suggest_numeric_columns(df: DataFrame) -> list[str]:
    native = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    parses = _probe(df, _strings(df), parse_numeric)
    return native + [c for c in _strings(df) if parses[c]]


def pick_value_column(df: DataFrame) -> str:
    names = {c.lower(): c for c in df.columns}
    for wanted in VALUE_NAMES:
        if wanted in names:
            return names[wanted]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        raise ValueError("no numeric column")
    return numeric[-1]


def check_schema(df: DataFrame, required, value: str) -> DataFrame:
    """One row: ``is_valid, issues, warnings, row_count``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in required if c not in types]
    issues = [F.lit("Missing required columns: " + ", ".join(missing))] if missing else []
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    warnings = ([f"Value column {value} should be numeric"]
                if value in types and not isinstance(types[value], numeric) else [])
    empty = F.when(F.col("row_count") == 0, F.lit("DataFrame is empty"))
    return (df.agg(F.count(F.lit(1)).alias("row_count"))
            .withColumn("issues", F.array_compact(F.array(*issues, empty)))
            .withColumn("warnings", F.array(*[F.lit(w) for w in warnings]).cast("array<string>"))
            .select((F.size("issues") == 0).alias("is_valid"), "issues", "warnings", "row_count"))


def profile_frame(df: DataFrame) -> DataFrame:
    """Row, column and partition counts."""
    return (df.groupBy(F.spark_partition_id().alias("p")).count()
            .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.count("*").alias("partitions"))
            .select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "partitions"))


def _share(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long")


def sample_rows(df: DataFrame, fraction: float, key: str | None = None) -> DataFrame:
    """Keep rows by a hash rule on ``key`` (or on the whole row): the same rows whatever the partitioning."""
    whole = F.col(key) if key else F.to_json(F.struct(*df.columns))
    return df.filter(_share(whole) < int(fraction * 0xFFFFFF))


def sample_series(df: DataFrame, fraction: float, by: str = SERIES) -> DataFrame:
    """Keep whole series by a hash rule on their id: no shuffle, the same series on every run."""
    return df.filter(_share(F.col(by)) < int(fraction * 0xFFFFFF))
