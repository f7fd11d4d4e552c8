"""What the corpus operators share: tables, written steps, slices of Arrow batches, word hashes.

Python kernels here never see more than one slice of a batch at a time: a slice is as many rows as hold
``SLICE_BYTES`` of text, or one row if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.layout import durable, scratch_path  # noqa: F401

SLICE_BYTES = 2_000_000
#: The ASCII white space of the word and line rules, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` (null text: empty) and nothing else, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def keep_only(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``dropped(doc_id)``; every other column stays as it is.

    Rows without a doc_id cannot be told apart, so none of them is dropped.
    """
    gone = dropped.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_doc_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_doc_id"], "left_anti")


def unsized(side: DataFrame) -> DataFrame:
    """One side of a join that Spark is to sort and merge, never to broadcast.

    Spark takes Python functions and explodes to return no more bytes than they read, and files for as many bytes as they have when
    compressed, so it would send tables through the driver that are many times what it broadcasts knowingly.
    """
    return side.hint("merge")


def spread_count(rows: int, per_task: int) -> int:
    return max(1, -(-int(rows) // per_task))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        starts = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public murmur3 constants) over unsigned arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, dtype=np.uint64)
    done, step = 1, base & MASK
    while done <= n:
        take = min(done, n + 1 - done)
        out[done:done + take] = out[:take] * np.uint64(step)
        done, step = done * 2, step * step & MASK
    return out


class Rolling:
    """Digests of word ranges from prefix sums of a polynomial modulo 2**64 over mixed 64-bit word hashes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(hashes):
            size = max(1024, 2 * len(hashes))
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        out = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[:len(hashes)], out=out[1:])
        return out

    def digest(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


_HELD: dict[str, object] = {}


def held(key: str, make):
    """What ``make`` returns, kept for the next task of this worker process; a worker keeps one such object at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (XXH64 of the bytes) of all words (runs without ASCII white space) of some texts, and the number in each text.

    Words are split, and equal ones found, in Arrow; each different word is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.cast(pa.array(raws, pa.binary()), pa.string(), safe=False))
    words = split.flatten().cast(pa.binary()).dictionary_encode()
    names = words.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    code, counts = words.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in names:  # white space at either end of a text
        real = code != names.index(b"")
        before = np.concatenate([[0], np.cumsum(real)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        code, counts = code[real], np.diff(before[edges])
    return hashes[code], counts


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
