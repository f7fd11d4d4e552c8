"""Column expressions that keep ANSI mode from failing on user data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def div(a, b) -> Column:
    """``a / b`` as double, NULL where ``b`` is 0 or NULL."""
    return F.try_divide(F.lit(a).cast("double") if not isinstance(a, Column) else a.cast("double"),
                        F.lit(b).cast("double") if not isinstance(b, Column) else b.cast("double"))


def clean(value: Column) -> Column:
    """NaN becomes NULL; infinities stay."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < INFINITY)


def non_negative(value: Column) -> Column:
    return F.when(value > 0, value).otherwise(F.when(value.isNotNull(), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, start: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body(state, value)`` inside an array fold."""
    return F.aggregate(F.array(value), start, body)
