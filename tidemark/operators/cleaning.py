"""Missing values and train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import layout
from tidemark.functions.guards import finite
from tidemark.layout import BY, IDX, VALUE


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with a value; positions, if any, are dropped because they would no longer be dense."""
    return (df.filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
            .drop(IDX, layout.CHUNK))


fill_drop = drop_missing


def _ends(df: DataFrame, by):
    known = F.when(F.col(VALUE).isNotNull(), F.struct(F.col(IDX).alias("i"), F.col(VALUE).alias("v")))
    d = layout.with_carried(df, "_prev", known, True, by)
    return layout.with_carried(d, "_next", known, False, by)


def fill_linear(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Straight line between neighbours on position, flat at both ends."""
    s = _ends(layout.with_index(df, by, bounded=bounded), by)
    a, b = F.col("_prev"), F.col("_next")
    gap = F.nullif(b["i"] - a["i"], F.lit(0))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(IDX) - a["i"]) / gap
    return s.withColumn(VALUE, F.coalesce(F.col(VALUE), line, a["v"], b["v"])).drop("_prev", "_next")


def fill_forward(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_index(df, by, bounded=bounded)
    return layout.with_carried(s, VALUE, F.col(VALUE), True, by)


def fill_backward(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    s = layout.with_index(df, by, bounded=bounded)
    return layout.with_carried(s, VALUE, F.col(VALUE), False, by)


def fill_nonfinite_median(df: DataFrame, by=BY, bounded: bool = False) -> DataFrame:
    """Missing or infinite values become the median of the finite ones."""
    s = layout.with_index(df, by, bounded=bounded)
    good = F.when(finite(F.col(VALUE)), F.col(VALUE))
    median = layout.quantiles(s.withColumn("_good", good), [0.5], "_good", by)
    filled = layout.join_series(s, median, by)
    return filled.withColumn(VALUE, F.coalesce(good, F.col("q")[0])).drop("q")


def train_test_split(df: DataFrame, test_ratio: float = 0.2, by=BY, bounded: bool = False) -> DataFrame:
    """Chronological split: the last ``max(1, round(n * ratio))`` rows are the test part."""
    s = layout.with_totals(layout.with_index(df, by, bounded=bounded), by, n=F.count("*"))
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * test_ratio, 0).cast("long"))
    return s.withColumn("role", F.when(F.col(IDX) < F.col("n") - n_test, "train").otherwise("test"))
