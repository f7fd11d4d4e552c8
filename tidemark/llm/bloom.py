"""Bloom filters of bounded size over 64-bit keys: which rows of a large table a join can need.

A filter is or-ed together in Spark and has at most ``MOST_BITS`` bits however many keys there are, so it can be
sent to all tasks.  A false hit only lets one row more through to the exact join or count after it; with more keys than the filter
was made for there are more of these, never a lost row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bits for each key, and the most a filter has (8 MB).
BITS_EACH = 16
MOST_BITS = 1 << 26
PROBES = 3


class Bloom:
    """Membership of 64-bit keys; ``cells`` are 64-bit words, a power of two of them."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def places(self, keys: np.ndarray, cells: int):
        for probe in range(PROBES):
            mixed = common.mix(keys + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 & common.MASK))
            yield (mixed >> np.uint64(6)) & np.uint64(cells - 1), mixed & np.uint64(63)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for cell, bit in self.places(keys, len(self.cells)):
            out &= self.cells[cell.astype(np.int64)] >> bit & np.uint64(1) == 1
        return out


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of ``keys(key long)``: its words are or-ed together in Spark; the driver sees the filter alone."""
    bits = 64
    wanted = min(MOST_BITS, BITS_EACH * keys.count())
    while bits < wanted:
        bits *= 2
    cells = bits // 64

    def run(batches):
        for batch in batches:
            at, value = [], []
            for cell, bit in Bloom(np.zeros(1, np.uint64)).places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), cells):
                at.append(cell.astype(np.int64))
                value.append(common.signed(np.uint64(1) << bit))
            yield pa.record_batch({"cell": pa.array(np.concatenate(at)), "bits": pa.array(np.concatenate(value))})

    table = keys.select("key").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells, dtype=np.uint64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Bloom(out)


def only(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``column`` (a long) may be in ``keys(key long)``; the other columns stay in the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_of(keys))

    def held(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(values.to_numpy(np.int64).view(np.uint64)))

    return rows.where(F.pandas_udf(held, "boolean")(F.coalesce(column, F.lit(0).cast("long"))))
