"""Collocations by Toivonen's sampling method: exact counts of all frequent phrases from few passes.

1. *Sample.*  A share of the documents, drawn by hash, is mined with a lowered threshold; its frequent phrases of one
   to five words are proposed.
2. *Full pass.*  Every phrase whose first and last parts (all but one word) are proposed is counted over all
   documents: the proposed ones and their negative border.  Border phrases that do not occur need no count.
3. *Expansion.*  A border phrase that turns out frequent means that phrases around it may have been missed.  One more
   pass counts, from the shortest up, every phrase that holds a failed one (or a phrase new in this pass) and whose
   parts are proposed, failed or new.  By induction over the length every frequent phrase is then counted: both of its
   parts are frequent, so each is proposed, failed or new.  So one expansion closes the search.

A pass counts inside a slice of text first: words get numbers, and a phrase of k words is a pair of overlapping
phrases of k - 1 words, so each length is one sort of integers.  What tasks know of the proposed phrases is a Bloom
filter of bounded size (``bloom.MOST_BITS``) over 64-bit phrase keys, whatever the corpus: a false hit only counts one phrase more, as the
decision depends on the phrase alone.  Border phrases travel as keys and become words only where they fail; counts
of candidates are summed by their words.

Defined cases: a null lang is ``und``; null and empty texts have no words; repeated rows count as often as they occur; ties are
ordered by the phrase; no join is on doc_id, so null ids pass; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.bloom import Bloom, bloom_of

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Share of the documents in the sample, in per cent, and the standard deviations by which its threshold is lowered.
SAMPLE_PERCENT = 20
DEVIATIONS = 3.0
SLICE_BYTES = 2_500_000
BREAK = b"\n"
_TABLE = bytearray(bytes(range(256)).lower())
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = BREAK[0]
_TABLE[9] = 32
TABLE = bytes(_TABLE)


def words_of(raws: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of all words of some texts in order, 0 where a piece ends, and the words by number."""
    numbers = defaultdict(count().__next__)
    _, nothing = numbers[BREAK], numbers[b""]
    split = BREAK.join(raws).translate(TABLE).replace(BREAK, b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, split), np.int64, len(split))
    return ids[ids != nothing], list(numbers)


class _Counts:
    """Rows of one slice: key, lang, phrase (None for a border phrase) and count."""

    def __init__(self):
        self.key, self.lang, self.phrase, self.n = [], [], [], []

    def add(self, key, n, lang=None, phrases=None):
        self.key.append(key)
        self.n.append(n)
        self.lang.append(pa.array([lang] * len(key), pa.string()))
        self.phrase.append(pa.array(phrases, pa.binary()) if phrases is not None else pa.nulls(len(key), pa.binary()))

    def batch(self):
        return pa.record_batch({
            "key": pa.array(common.signed(np.concatenate(self.key))), "lang": pa.concat_arrays(self.lang),
            "phrase": pa.concat_arrays(self.phrase).cast(pa.string()), "n": pa.array(np.concatenate(self.n).astype(np.int64))})


def _count(lang: str, raws: list[bytes], out: _Counts, proposed: Bloom | None, failed: Bloom | None) -> None:
    """Count the phrases of one language in one slice.

    Without filters every phrase (the sample); with ``proposed`` alone the proposed phrases and their border; with ``failed``
    as well what the expansion needs.
    """
    ids, names = words_of(raws)
    seed = xxhash.xxh64_intdigest(lang.encode())
    word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
    total = int(np.count_nonzero(ids))
    if failed is None:
        out.add(np.zeros(1, np.uint64), np.array([total]), lang, [b""])
    # code: number of the phrase that starts at a word, -1 where none does that longer ones may be built from
    code, key, fresh = ids, np.zeros(1, np.uint64), np.zeros(1, bool)
    for size in range(1, LONGEST + 1):
        if size == 1:
            at = np.flatnonzero(ids)
            group = ids[at]
        else:
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
            group = code[at] * (1 << 31) + code[at + 1]
        if not len(at):
            return
        _, first, inverse, n = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        first = at[first]
        last_word = word_hash[ids[first + size - 1]]
        parts_fresh = np.zeros(len(first), bool) if size == 1 else fresh[code[first]] | fresh[code[first + 1]]
        key = common.mix((key[code[first]] if size > 1 else np.uint64(0)) * np.uint64(0x9FB21C651E98DF25) + last_word + np.uint64(size))
        known = proposed.has(key) if proposed else np.ones(len(key), bool)
        phrases = lambda chosen: [b" ".join([names[i] for i in row]) for row in ids[first[chosen][:, None] + np.arange(size)].tolist()]
        if proposed is None:
            out.add(key, n)
            grows = known
        elif failed is None:
            out.add(key[known], n[known], lang, phrases(known))
            out.add(key[~known], n[~known])
            grows = known
        else:
            new = parts_fresh | (~known & failed.has(key))
            out.add(key[new], n[new], lang, phrases(new))
            grows, parts_fresh = known | new, new
        fresh = parts_fresh
        here = np.where(grows, np.arange(len(first)), -1)[inverse]
        code = np.full(len(ids), -1, dtype=np.int64)
        code[at] = here


def counted(docs: DataFrame, proposed: Bloom | None = None, failed: Bloom | None = None) -> DataFrame:
    """``key, lang, phrase, n`` summed over all slices; docs: lang, text."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((proposed, failed))  # at most two filters of bloom.MOST_BITS

    def run(batches):
        wanted, missed = shared.value
        for part in common.slices(batches, limit=SLICE_BYTES):
            texts: dict[str, list[bytes]] = {}
            for lang, raw in zip(part.column(0).to_pylist(), common.raw_texts(part)):
                texts.setdefault(lang, []).append(raw)
            out = _Counts()
            for lang, raws in texts.items():
                _count(lang, raws, out, wanted, missed)
            if out.key:
                yield out.batch()

    rows = docs.mapInArrow(run, "key long, lang string, phrase string, n long")
    return rows.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("n"))


def sample_threshold(least: int, percent: int) -> int:
    expected = least * percent / 100
    return max(2, int(expected - DEVIATIONS * expected ** 0.5))


def frequent_phrases(docs: DataFrame, least: int = LEAST, percent: int = SAMPLE_PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n)`` of all phrases of one to five words that occur ``least`` times, and ``(lang, n)`` of all words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("draw"))
    sample = counted(rows.where(F.pmod("draw", F.lit(100)) < percent).select("lang", "text"))
    chosen = common.durable(sample.where((F.col("n") >= sample_threshold(least, percent)) & F.col("phrase").isNull()).select("key"))
    proposed = bloom_of(chosen)
    texts = rows.select("lang", "text")
    full = common.durable(counted(texts, proposed).where((F.col("n") >= least) | (F.col("phrase") == "")))
    found = full.where("phrase <> ''").select("lang", "phrase", "n")
    border = full.where("phrase IS NULL").select("key")
    if not border.isEmpty():
        more = common.durable(counted(texts, proposed, bloom_of(border)).where((F.col("n") >= least) & (F.col("phrase") != "")))
        found = found.unionByName(more.select("lang", "phrase", "n")).distinct()
    return common.durable(found.where(F.col("n") >= least)), full.where("phrase = ''").select("lang", "n")


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = SAMPLE_PERCENT) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    known, totals = frequent_phrases(docs, least, percent)
    words = F.split("phrase", " ")
    candidates = known.withColumn("w", words).withColumn("k", F.size("w")).where("k > 1").withColumnRenamed("n", "a")
    cut = (candidates.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
           .select("lang", "phrase", "a", "at", _joined(F.col("w"), F.lit(1), F.col("at")).alias("head"),
                   _joined(F.col("w"), F.col("at") + 1, F.col("k") - F.col("at")).alias("tail")))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang").withColumns(
        {"_over": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "_under": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    covers = (candidates.where("k > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longest_a")))
    kept = best.join(covers, ["lang", "phrase"], "left").where("longest_a IS NULL OR longest_a < b.a")
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]))
