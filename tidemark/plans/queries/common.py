"""Registration and the rounding both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.series import Tables

REGISTRY: dict = {}
DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, widen integers: summation order differs between engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``build(tables) -> DataFrame`` under ``name``."""
    def register(build):
        def run(spark, folder):
            return finish(build(Tables(spark, folder)), digits)
        run.__name__ = name
        REGISTRY[name] = (run, sql)
        return build
    return register


def r(expression: str, digits: int = DIGITS) -> str:
    """SQL text of a rounded value; adding 0.0 removes negative zeros."""
    return f"round({expression}, {digits}) + 0.0"
