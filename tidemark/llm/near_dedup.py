"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it.  Two fingerprints that
differ in at most three of 64 bits agree entirely in one of four 16-bit segments; of the remaining 48 bits,
taken as two 24-bit words, one holds at most one of the errors.  The extended Golay code (24, 12, 8)
decodes that word: an odd word lies nearest to one codeword; an even one at distance four lies between
six, and gets all six.  Words one bit apart always share a codeword.  Each fingerprint so has 8 to 48 keys (about
25): exact segment, which half, codeword index.  Keys that several different fingerprints share are joined,
and every candidate is verified with a popcount.

Equal fingerprints are one node, represented by the smallest doc_id.  A key shared by very many different
fingerprints is cut into blocks, and every pair of blocks is one bounded task group; from each group only
a spanning forest of its links leaves, which keeps the components exact without listing all pairs.

Keys, fingerprints and documents are joined by sorting: no table that grows with the documents passes the driver.

Defined cases: null or empty text has fingerprint zero and links like any other; one or two words are one shingle; repeated
rows and equal doc_ids share their component; a null doc_id stays a row and takes the component of its
fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCK = 2048
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fixed value: generator polynomial of the binary Golay code (23, 12, 7).
GOLAY = 0xC75


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of one text, as an unsigned number."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (a signed long with the fingerprint's bits) for every row."""
    def run(batches):
        for part in common.slices(batches):
            prints = np.array([fingerprint(raw) for raw in common.raw_texts(part)], dtype=np.uint64)
            yield pa.record_batch({"doc_id": part.column(0), "print": pa.array(common.signed(prints))})
    return common.slim(docs).mapInArrow(run, "doc_id long, print long")


class Golay:
    """Nearest codewords of 24-bit words through a table from syndromes to error patterns."""

    def __init__(self):
        self.steps = np.array([self._parity(1 << b) for b in range(24)], dtype=np.int64)
        patterns: dict[int, list[int]] = {0: [0]}
        for weight in (1, 2, 3, 4):
            found: dict[int, list[int]] = {}
            for bits in combinations(range(24), weight):
                error = sum(1 << b for b in bits)
                found.setdefault(int(self.syndrome(np.array([error]))[0]), []).append(error)
            for s, errors in found.items():
                patterns.setdefault(s, errors)
        self.errors = np.full((4096, 6), -1, dtype=np.int64)
        for s, errors in patterns.items():
            self.errors[s, :len(errors)] = errors

    @staticmethod
    def _parity(word: int) -> int:
        """Syndrome of a word: remainder of its lower 23 bits by the generator, and its overall parity."""
        rest = word & 0x7FFFFF
        for b in range(22, 10, -1):
            if rest >> b & 1:
                rest ^= GOLAY << (b - 11)
        return rest << 1 | word.bit_count() & 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for b in range(24):
            out ^= np.where(words >> b & 1, self.steps[b], 0)
        return out

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the nearest codewords, -1 where there are fewer."""
        errors = self.errors[self.syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11 & 0xFFF)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    code, rows, keys = Golay(), [], []
    segments = [(prints >> np.uint64(16 * s)).astype(np.int64) & 0xFFFF for s in range(4)]
    for s in range(4):
        rest = [segments[k] for k in range(4) if k != s]
        for half, word in enumerate((rest[0] | (rest[1] & 0xFF) << 16, rest[1] >> 8 | rest[2] << 8)):
            found = code.indices(word)
            row, column = np.nonzero(found >= 0)
            rows.append(row)
            keys.append(((s * 2 + half) << 28) | segments[s][row] << 12 | found[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(parts):
    for part in parts:
        prints = part["print"].to_numpy(np.int64)
        for at in range(0, len(prints), 20_000):
            row, key = fuzzy_keys(prints[at:at + 20_000].view(np.uint64))
            yield pd.DataFrame({"key": key, "print": prints[at:at + 20_000][row]})


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b (indices) make up a spanning forest."""
    parent = list(range(int(max(a.max(), b.max())) + 1))
    keep = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def _links_of(group: np.ndarray, side: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a spanning forest) inside the runs of equal ``group``; rows are sorted by group."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    left, right = [], []
    sizes = np.diff(edges)
    small = np.repeat(sizes, sizes) <= 64
    index = np.flatnonzero(small)
    for step in range(1, 64):  # short runs together, one distance after the other
        index = index[index + step < len(group)]
        index = index[group[index] == group[index + step]]
        if not len(index):
            break
        near = np.bitwise_count(prints[index] ^ prints[index + step]) <= MOST_BITS
        left.append(index[near])
        right.append(index[near] + step)
    for start, end in zip(edges[:-1][sizes > 64], edges[1:][sizes > 64]):
        # one row of the comparison at a time; rows that already hang together need no second link
        label = np.arange(end - start)
        for x in range(start, end - 1):
            near = np.flatnonzero(np.bitwise_count(prints[x] ^ prints[x + 1:end]) <= MOST_BITS) + x + 1
            near = near[label[near - start] != label[x - start]]
            if len(near):
                _, first = np.unique(label[near - start], return_index=True)
                left.append(np.full(len(first), x))
                right.append(near[first])
                label[np.isin(label, label[near[first] - start])] = label[x - start]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a):
        keep = _forest(a, b)
        a, b = a[keep], b[keep]
    return a, b


def _verified(parts):
    """Links inside the groups of a partition that is sorted by (key, pair); a group never spans two yields."""
    held = None
    def links(rows):
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        group = common.mix(rows["key"].to_numpy(np.int64).view(np.uint64)) ^ rows["pair"].to_numpy(np.int64).view(np.uint64)
        a, b = _links_of(group, None, prints)
        a, b = common.signed(prints[a]), common.signed(prints[b])
        return pd.DataFrame({"a": a, "b": b}).query("a != b").drop_duplicates()
    for part in parts:
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        last = (rows["key"] == rows["key"].iloc[-1]) & (rows["pair"] == rows["pair"].iloc[-1])
        held, ready = rows[last], rows[~last]
        if len(ready):
            yield links(ready)
    if held is not None and len(held):
        yield links(held)


def near_links(prints: DataFrame) -> DataFrame:
    """``a, b``: links between different fingerprints that keep the components of all links.

    prints: one column ``print`` of different fingerprints.  Keys held by one fingerprint alone are left out;
    a key with more than ``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is a group.
    """
    keyed = prints.select("print").mapInPandas(_keyed, "key long, print long")
    shared = (keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
              .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = keyed.join(common.unsized(shared), "key")
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least("own", "other").cast("long") * (1 << 32)) + F.greatest("own", "other")
    rows = rows.select("key", pair.alias("pair"), "print")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(tasks, "key", "pair").sortWithinPartitions("key", "pair", "print")
            .mapInPandas(_verified, "a long, b long"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    marked = common.durable(fingerprints(docs))
    # nodes are numbered by the smallest doc_id that has the fingerprint, so the smallest node names the component
    nodes = common.durable(marked.groupBy("print").agg(F.min("doc_id").alias("rep")))
    links = near_links(nodes)
    a, b = nodes.select(F.col("print").alias("a"), F.col("rep").alias("ra")), nodes.select(F.col("print").alias("b"), F.col("rep").alias("rb"))
    named = links.join(common.unsized(a), "a").join(common.unsized(b), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    found = components(named)
    classes = nodes.join(common.unsized(found), nodes["rep"] == found["node"], "left").select(
        F.col("print").alias("class_print"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(common.unsized(classes), marked["print"] == classes["class_print"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near-duplicates."""
    return common.keep_only(docs, near_groups(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
