"""Removal of long repeated word windows, found by recompression.

Recompression names token runs and adjacent pairs in rounds.  A name is a 64-bit hash of the names it
replaces, so every task gives equal runs and pairs equal names without a naming table; which pairs are merged is
decided by one bit of each name (left symbols merge with right symbols), which is the same rule for the whole corpus.
Each symbol remembers the words its identity depends on.  A window determines every symbol whose dependencies
lie inside it, and the leftmost such symbol is its anchor; equal windows have equal anchors at equal offsets.

1. Successive windows with one anchor form a group, written as (anchor name, digest of the group's whole span).
   Anchors that occur in one document only cannot be part of a repeat and go.
2. Groups with equal name and digest are equal word for word: all but those of the smallest doc_id are repeats.
3. Where an anchor has different spans, one representative of each span (its smallest doc_id) is compared window by
   window with 128-bit digests, which finds the edges of shared passages.
4. Removed windows are brought back to the documents, which are cut and digested.

A passage copied a thousand times is one row after the first aggregate; nothing lists pairs of copies.

Defined cases: null and empty texts have no words and the digest of the empty string; documents shorter than a window
keep all words; windows repeated inside one document only stay; rows that repeat a doc_id never remove from each other, and
each is cut by its own text; a null doc_id counts as larger than any other; an empty table gives an empty result.  Documents are compared
by doc_id and cut by (doc_id, hash of the text), so rows that share an id, or have none, keep their own spans.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

WINDOW = 50
ROUNDS = 8
#: Symbols grow to this many words at most, so that every window holds whole ones.
LONGEST = 8
NULL_DOC = np.iinfo(np.int64).max
_SPAN, _WIDE, _OTHER = common.Rolling(0x9E3779B97F4A7C15), common.Rolling(0xD6E8FEB86659FD93), common.Rolling(0xA0761D6478BD642F)


@dataclass
class Words:
    """The words of a slice: hashes, and for each document its first and last position."""
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words_of(raws: list[bytes]) -> Words:
    hashes, sizes = common.hash_words(raws)
    last = np.cumsum(sizes)
    return Words(hashes, last - sizes, last)


@dataclass
class Symbols:
    """Symbols of a round: name, number of words, document, and the words their identity depends on."""
    name: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def joined(self) -> np.ndarray:
        """Whether a symbol has the same document as the one before it."""
        return np.concatenate([[False], self.doc[1:] == self.doc[:-1]])


def _first_round(words: Words) -> Symbols:
    """Single words and named runs of equal words.  A run depends on the word before and after it."""
    n, sizes = len(words.hashes), words.last - words.first
    doc = np.repeat(np.arange(len(sizes)), sizes)
    name = common.mix(words.hashes)
    head = np.ones(n, dtype=bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, n))
    run = common.mix(name[start] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Symbols(np.where(size > 1, run, name[start]), size, doc[start], start - 1, start + size + 1)


def _pair_round(s: Symbols, number: int) -> Symbols:
    """Merge every left symbol with the right symbol after it, by name, unless they grow too long."""
    n = len(s.name)
    coin = common.mix(s.name + np.uint64(number * 0x632BE59BD9B4E019 & common.MASK)) >> np.uint64(63) == 1
    same = s.joined()
    low, high = s.low.copy(), s.high.copy()
    # a right symbol depends on the symbol before it, a left symbol on the one after it; at the edge of a
    # document on what no window can hold
    right = np.flatnonzero(coin)
    before = np.maximum(right - 1, 0)
    inside = same[right]
    low[right] = np.where(inside, np.minimum(s.low[right], s.low[before]), -1)
    high[right] = np.maximum(s.high[right], np.where(inside, s.high[before], 0))
    left = np.flatnonzero(~coin)
    after = np.minimum(left + 1, n - 1)
    inside = (left + 1 < n) & same[after]
    high[left] = np.where(inside, np.maximum(s.high[left], s.high[after]), np.iinfo(np.int64).max)
    low[left] = np.minimum(s.low[left], np.where(inside, s.low[after], s.low[left]))
    merged = np.flatnonzero(same[1:] & ~coin[:-1] & coin[1:] & (s.size[:-1] + s.size[1:] <= LONGEST)) if n else np.zeros(0, np.int64)
    name, size = s.name.copy(), s.size.copy()
    name[merged] = common.mix(s.name[merged] * np.uint64(0x9FB21C651E98DF25) + common.mix(s.name[merged + 1]) + np.uint64(number))
    size[merged] += s.size[merged + 1]
    low[merged], high[merged] = np.minimum(low[merged], low[merged + 1]), np.maximum(high[merged], high[merged + 1])
    stay = np.ones(n, dtype=bool)
    stay[merged + 1] = False
    return Symbols(name[stay], size[stay], s.doc[stay], low[stay], high[stay])


def recompress(words: Words, rounds: int = ROUNDS) -> Symbols:
    out = _first_round(words)
    for number in range(rounds):
        if len(out.name):
            out = _pair_round(out, number)
    return out


@dataclass
class Groups:
    """Runs of windows with one anchor: document, first window (position in the slice), number, name, span digest."""
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    name: np.ndarray
    digest: np.ndarray


def groups_of(words: Words, window: int = WINDOW) -> Groups:
    symbols = recompress(words)
    starts = np.cumsum(symbols.size) - symbols.size
    n = len(words.hashes)
    owner = np.full(n, -1, dtype=np.int64)
    # windows that hold all a symbol depends on: from high - window to low, inside the document
    a = np.maximum(symbols.high - window, words.first[symbols.doc])
    b = np.minimum(symbols.low, words.last[symbols.doc] - window)
    some = np.flatnonzero((a <= b) & (symbols.high < n + window + 1))[::-1]
    counts = b[some] - a[some] + 1
    offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner[np.repeat(a[some], counts) + offsets] = np.repeat(some, counts)  # written last: the leftmost symbol
    sizes = words.last - words.first
    doc = np.repeat(np.arange(len(sizes)), sizes)
    window_at = np.flatnonzero(np.arange(n) + window <= words.last[doc]) if n else np.zeros(0, np.int64)
    own, of = owner[window_at], doc[window_at]
    head = np.ones(len(window_at), dtype=bool)
    head[1:] = (own[1:] != own[:-1]) | (own[1:] < 0) | (of[1:] != of[:-1])
    at = np.flatnonzero(head)
    first, count = window_at[at], np.diff(np.append(at, len(window_at)))
    sums = _SPAN.sums(common.mix(words.hashes))
    digest = _SPAN.digest(sums, first, first + count + window - 1)
    anchor = own[at]
    offset = np.where(anchor < 0, 0, starts[np.maximum(anchor, 0)] - first) if len(starts) else np.zeros(len(at), np.int64)
    digest = common.mix(digest + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    # a window that determines no symbol is its own anchor
    name = np.where(anchor < 0, digest, symbols.name[np.maximum(anchor, 0)]) if len(starts) else digest
    return Groups(of[at], first, count, name, digest)


def _doc_ids(part) -> np.ndarray:
    return part.column(0).fill_null(int(NULL_DOC)).to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``: with the doc_id, the hash of the text tells rows apart."""
    return common.slim(docs).withColumn("key", F.xxhash64("text"))


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per group: name, digest, doc, key, first (word position), count."""
    def run(batches):
        for part in common.slices(batches):
            words, ids = words_of(common.raw_texts(part)), _doc_ids(part)
            g = groups_of(words, window)
            yield pa.record_batch({
                "name": pa.array(common.signed(g.name)), "digest": pa.array(common.signed(g.digest)), "doc": pa.array(ids[g.doc]),
                "key": part.column(2).take(pa.array(g.doc)), "first": pa.array((g.first - words.first[g.doc]).astype(np.int32)), "count": pa.array(g.count.astype(np.int32))})
    return _keyed(docs).mapInArrow(run, "name long, digest long, doc long, key long, first int, count int")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Digests of single windows: one, two (128 bits), doc, key, first; for the groups in ``wanted(doc, key, first, count)``."""
    per_doc = wanted.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "count")).alias("spans"))
    rows = docs.select(F.coalesce("doc_id", F.lit(int(NULL_DOC))).alias("doc"), "text", "key").join(per_doc, ["doc", "key"]).select("doc", "text", "spans", "key")

    def run(batches):
        for part in common.slices(batches):
            out, (hashes, counts) = [], common.hash_words(common.raw_texts(part))
            edges = np.cumsum(np.concatenate([[0], counts])).tolist()
            for doc, a, b, spans, key in zip(part.column(0).to_pylist(), edges[:-1], edges[1:], part.column(2).to_pylist(), part.column(3).to_pylist()):
                at = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["count"]) for s in spans]))
                mixed = common.mix(hashes[a:b])
                one, two = (r.digest(r.sums(mixed), at, at + window) for r in (_WIDE, _OTHER))
                out.append((one, two, np.full(len(at), doc), np.full(len(at), key), at))
            one, two, doc, key, at = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch({"one": pa.array(common.signed(one)), "two": pa.array(common.signed(two)),
                                   "doc": pa.array(doc.astype(np.int64)), "key": pa.array(key.astype(np.int64)), "first": pa.array(at.astype(np.int32))})
    return rows.mapInArrow(run, "one long, two long, doc long, key long, first int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, key, first, count``: runs of windows that also start in a document with a smaller doc_id."""
    docs = _keyed(docs)
    found = anchors(docs, window)
    # aggregates are written before they are joined: joins between plain shuffles can be split where a name is hot
    shared = common.durable(found.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
                            .where("least < most").select("name"))
    held = common.durable(found.join(shared, "name"))
    spans = common.durable(held.groupBy("name", "digest").agg(F.min("doc").alias("least")))
    several = common.durable(spans.groupBy("name").agg(F.count("*").alias("spans")))
    marked = common.durable(spans.join(several, "name"))
    judged = common.durable(held.join(marked, ["name", "digest"]).select("doc", "key", "first", "count", "least", "spans"))
    whole = judged.where("doc > least").select("doc", "key", "first", "count")
    single = common.durable(_windows(docs, judged.where("doc = least AND spans > 1"), window))
    least = common.durable(single.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most"))
    edges = single.join(least, ["one", "two"]).where("doc > least").select("doc", "key", "first", F.lit(1).alias("count"))
    return whole.unionByName(edges)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the remaining words, joined by one space), kept_sha256."""
    # a set: rows repeated with id and text add no spans, so no group outgrows one text
    removed = repeated_windows(docs, window).groupBy("doc", "key").agg(F.collect_set(F.struct("first", "count")).alias("spans"))
    rows = (_keyed(docs).withColumn("doc", F.coalesce("doc_id", F.lit(int(NULL_DOC)))).join(removed, ["doc", "key"], "left")
            .select("doc_id", "text", "spans"))

    def run(batches):
        for part in common.slices(batches):
            counts, gone, kept = [], [], []
            for raw, spans in zip(common.raw_texts(part), part.column(2).to_pylist()):
                words = raw.split()
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    a = np.array([s["first"] for s in spans])
                    b = np.array([s["first"] + s["count"] + window - 1 for s in spans])
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    left = words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                                   "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
