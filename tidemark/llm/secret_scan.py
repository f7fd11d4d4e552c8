"""Secrets in texts: fixed patterns, and random-looking strings by two character Markov models, in SQL functions only.

Patterns find assigned values, access keys and long hexadecimal runs.  The values they find, as labelled samples of random
strings, and words of documents without any, as labelled samples of ordinary identifiers, train two first-order
character models.  A long run of key characters that no pattern covers is a secret as well if its mean log-likelihood
ratio per character pair exceeds ``LEAST_RATIO``.  The models are one table of 128 x 128 ratios.

Training reads a bounded sample: at most ``MOST_VALUES`` different values and the words of at most ``MOST_DOCS`` documents,
chosen by hash.  Scanning covers every whole text.

Positions come without leaving the JVM: a text split by a pattern gives the lengths between the matches.

Defined cases: null and empty texts hold nothing; without samples of both kinds no span is added; equal starts are ordered
by kind; repeated rows come out alike; positions are in code points; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the three kinds and the length that group 2 or the match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LEAST = 8
#: Runs of key characters that the models judge.
RUN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}"
WORD = r"[A-Za-z][A-Za-z0-9_]{5,}"
LEAST_RATIO = 0.5
MOST_VALUES = 20_000
MOST_DOCS = 4_000
_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _located(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All matches as (start, rank, end, value), in code points; value is the group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    parts = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))

    def step(s, x):
        start = s["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(s["spans"], F.array(one)).alias("spans"))
    none = F.array().cast(_SPANS)
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind; the value of an assignment is what is assigned."""
    assign = F.filter(_located(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, _located(text, ACCESS, 1), _located(text, HEX, 2)))


def _pairs(words: DataFrame, column: str) -> DataFrame:
    """How often each pair of successive characters occurs: first, second (codes), n."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, F.lit(2))))
    return (words.where(F.length(column) > 1).select(pair.alias("pair"))
            .select(F.ascii(F.substring("pair", 1, 1)).alias("first"), F.ascii(F.substring("pair", 2, 1)).alias("second"))
            .where("first < 128 AND second < 128").groupBy("first", "second").agg(F.count("*").alias("n")))


def _model(counts: list) -> np.ndarray | None:
    """log P(second | first) with half a count for every printable character; counts: at most 128 x 128 rows."""
    if not counts:
        return None
    seen = np.full((128, 128), 0.0)
    for r in counts:
        seen[r["first"], r["second"]] += r["n"]
    seen[32:127, 32:127] += 0.5
    return np.log((seen + 1e-9) / (seen.sum(axis=1, keepdims=True) + 128e-9))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the character pair a, b at 128 a + b; zeros without samples."""
    docs = common.slim(docs)
    spans = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    values = spans.select(F.explode("base").alias("span")).select(F.col("span.value").alias("value")).distinct()
    values = values.orderBy(F.xxhash64("value"), "value").limit(MOST_VALUES)
    some = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCS)
    clean = docs.join(F.broadcast(some), "doc_id").where(F.size(base_spans(F.col("text"))) == 0)  # at most MOST_DOCS ids
    words = clean.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    random, ordinary = _model(_pairs(values, "value").collect()), _model(_pairs(words, "word").collect())
    if random is None or ordinary is None:
        return [0.0] * (128 * 128)
    return (random - ordinary).round(4).ravel().tolist()


def mean_ratio(word: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of an ASCII string."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # a constant
    code = lambda i: F.ascii(F.substring(word, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0.0),
                        lambda s, i: s + F.element_at(ratios, code(i) * 128 + code(i + 1) + 1))
    return total / (F.length(word) - 1)


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """Per row: doc_id, ``base`` and ``added``, arrays of (start, rank, end, value)."""
    table = train(docs) if table is None else table
    rows = common.slim(docs).select("doc_id", base_spans(F.col("text")).alias("base"), _located(F.col("text"), RUN, 3).alias("runs"))
    apart = lambda s, base: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select("doc_id", "base", F.filter(
        F.filter("runs", lambda s: apart(s, F.col("base"))), lambda s: mean_ratio(s["value"], table) > LEAST_RATIO).alias("added"))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Per row of ``scan``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        common.hex_sha256(_written(F.col("base"))).alias("base_sha256"),
                        _written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
