"""Exact deduplication through a sharded cuckoo-filter index of live digests.

A text is normalised (runs of ASCII white space become one space) and digested with SHA-256, JVM-side.
The index is a table with one row per shard: a cuckoo filter (four 16-bit fingerprints a bucket, two
candidate buckets a digest) and, slot for slot, the stored digest with the smallest doc_id and the
number of rows seen.  A fingerprint hit is verified against the digests in the two buckets; a miss is
inserted by displacement; when displacement runs out the filter doubles and is refilled from its
stored keys.  The number of shards follows the number of rows, so a shard has a bounded size.

A digest that fills a third of the table is summed up inside each task before the shuffle, so a shard
receives it a bounded number of times per task.

Defined cases: null text is empty; empty texts are one group; rows that repeat doc_id and text count
towards ``group_size`` and are marked alike; a null doc_id keeps only if its whole group has none, and the filter drops no row without one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SLOTS = 4
MAX_KICKS = 200
ROWS_PER_SHARD = 100_000
FLUSH = 100_000
NO_ID = np.iinfo(np.int64).max
INDEX_SCHEMA = "shard int, buckets int, filter binary, digests binary, keep_ids binary, sizes binary"


class CuckooIndex:
    """A cuckoo filter with the live digests bucketed beside the fingerprints."""

    def __init__(self, buckets: int = 64):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.stored: list[tuple[bytes, int, int] | None] = [None] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def find(self, digest: bytes) -> int:
        """The slot that holds ``digest``, or -1: fingerprint first, then the stored key."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.stored[slot][0] == digest:
                    return slot
        return -1

    def insert(self, digest: bytes, keep_id: int, size: int) -> bool:
        """Add rows of a digest; True if it was not live before."""
        slot = self.find(digest)
        if slot >= 0:
            _, old_id, old_size = self.stored[slot]
            self.stored[slot] = (digest, min(old_id, keep_id), old_size + size)
            return False
        self._place((digest, keep_id, size))
        return True

    def _place(self, item: tuple[bytes, int, int]) -> None:
        mark, first, second = self._places(item[0])
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = mark, item
                    return
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            item, self.stored[slot] = self.stored[slot], item
            mark, self.prints[slot] = self.prints[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = mark, item
                    return
        held = [x for x in self.stored if x] + [item]
        self._clear(self.buckets * 2)
        for x in held:
            self._place(x)

    def delete(self, digest: bytes) -> bool:
        slot = self.find(digest)
        if slot < 0:
            return False
        self.prints[slot], self.stored[slot] = 0, None
        return True

    def take(self, digest: bytes, keep_id: int, size: int) -> bool:
        """Take off ``size`` rows of a digest, the smallest of them ``keep_id``; at none left it goes.  True if it was live.

        Where the row that stayed is among them, the digest has no row to name (``NO_ID``) until ``name`` gives it one.
        """
        slot = self.find(digest)
        if slot < 0:
            return False
        _, old_id, old_size = self.stored[slot]
        if old_size <= size:
            return self.delete(digest)
        self.stored[slot] = (digest, NO_ID if keep_id <= old_id else old_id, old_size - size)
        return True

    def name(self, digest: bytes, keep_id: int) -> None:
        slot = self.find(digest)
        if slot >= 0 and self.stored[slot][1] == NO_ID:
            self.stored[slot] = (digest, keep_id, self.stored[slot][2])

    def live(self) -> list[tuple[bytes, int, int]]:
        return [x for x in self.stored if x]

    def row(self, shard: int) -> pd.DataFrame:
        empty = (bytes(32), NO_ID, 0)
        stored = [x or empty for x in self.stored]
        return pd.DataFrame([{
            "shard": shard, "buckets": self.buckets, "filter": np.array(self.prints, dtype=np.uint16).tobytes(),
            "digests": b"".join(x[0] for x in stored), "keep_ids": np.array([x[1] for x in stored], dtype=np.int64).tobytes(),
            "sizes": np.array([x[2] for x in stored], dtype=np.int64).tobytes()}])

    @staticmethod
    def read(row) -> CuckooIndex:
        out = CuckooIndex(int(row.buckets))
        out.prints = np.frombuffer(row.filter, dtype=np.uint16).tolist()
        ids, sizes = np.frombuffer(row.keep_ids, dtype=np.int64).tolist(), np.frombuffer(row.sizes, dtype=np.int64).tolist()
        out.stored = [(row.digests[32 * i:32 * i + 32], ids[i], sizes[i]) if mark else None for i, mark in enumerate(out.prints)]
        return out


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256`` of the normalised text of every row."""
    return common.slim(docs).select("doc_id", common.hex_sha256(F.regexp_replace("text", common.SPACE, " ")).alias("text_sha256"))


def _summed(shards: int):
    """Per task: one row a digest with its smallest doc_id and its count, flushed before the table grows large."""
    def rows(held: dict) -> pd.DataFrame:
        keys = list(held)
        return pd.DataFrame({"shard": [int.from_bytes(k[10:16], "little") % shards for k in keys], "digest": keys,
                             "keep_id": [held[k][0] for k in keys], "size": [held[k][1] for k in keys]})

    def run(parts):
        held: dict[bytes, list[int]] = {}
        for part in parts:
            for key, doc in zip(part["digest"], part["doc_id"].tolist()):
                old = held.get(key)
                if old is None:
                    held[key] = [doc, 1]
                else:
                    old[0], old[1] = min(old[0], doc), old[1] + 1
            if len(held) >= FLUSH:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)
    return run


def _to_shards(found: DataFrame, shards: int) -> DataFrame:
    source = found.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.unhex("text_sha256").alias("digest"))
    return source.mapInPandas(_summed(shards), "shard int, digest binary, keep_id long, size long")


def build(found: DataFrame, shards: int) -> DataFrame:
    """An index over ``found(doc_id, text_sha256)``, one row per shard."""
    def shard(key, rows):
        index = CuckooIndex()
        for item in zip(rows["digest"], rows["keep_id"].tolist(), rows["size"].tolist()):
            index.insert(*item)
        return index.row(int(key[0]))
    return _to_shards(found, shards).groupBy("shard").applyInPandas(shard, INDEX_SCHEMA)


def _changed(index: DataFrame, found: DataFrame, shards: int, change) -> DataFrame:
    def shard(key, held, rows):
        now = CuckooIndex.read(next(held.itertuples())) if len(held) else CuckooIndex()
        for digest, keep_id, size in zip(rows["digest"], rows["keep_id"].tolist(), rows["size"].tolist()):
            change(now, digest, keep_id, size)
        return now.row(int(key[0]))
    return index.groupBy("shard").cogroup(_to_shards(found, shards).groupBy("shard")).applyInPandas(shard, INDEX_SCHEMA)


def update(index: DataFrame, found: DataFrame, shards: int, remove: bool = False, left: DataFrame | None = None) -> DataFrame:
    """The index after the rows of ``found(doc_id, text_sha256)`` were inserted, or removed; ``shards`` as at ``build``.

    Removal takes rows off a digest's count, and the digest goes with its last row.  A digest that lost the row that stayed takes
    the smallest doc_id of ``left``, the rows still there; without ``left`` it has none.
    """
    if not remove:
        return _changed(index, found, shards, lambda now, digest, keep_id, size: now.insert(digest, keep_id, size))
    out = _changed(index, found, shards, lambda now, digest, keep_id, size: now.take(digest, keep_id, size))
    return out if left is None else _changed(out, left, shards, lambda now, digest, keep_id, size: now.name(digest, keep_id))


def live(index: DataFrame) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of every live digest."""
    def run(parts):
        for part in parts:
            for row in part.itertuples():
                items = CuckooIndex.read(row).live()
                if items:
                    yield pd.DataFrame({"text_sha256": [x[0].hex() for x in items], "keep_id": [x[1] for x in items],
                                        "group_size": [x[2] for x in items]})
    out = index.mapInPandas(run, "text_sha256 string, keep_id long, group_size long")
    return out.withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = digests(docs)
    shards = common.spread_count(docs.count(), ROWS_PER_SHARD)
    classes = live(common.durable(build(found, shards)))
    return (found.join(classes, "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts."""
    return common.keep_only(docs, exact_groups(docs).where(~F.col("kept")))
