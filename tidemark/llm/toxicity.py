"""Toxicity scores from compression distances to two zstandard dictionaries.

The ordinary dictionary is trained by the library on ordinary text.  The toxic dictionary is trained by contrast: the
library's own trainer takes the most frequent segments, which are the same in both classes, so its
segments are chosen here, as the word beginnings whose document frequency among toxic texts is many times that among
ordinary ones, the most frequent last, where zstandard reaches them cheapest.  It lies over the ordinary dictionary, and
the ordinary one is padded to equal length, so that offsets cost the same on both sides.

A window is one word (letters, lower case) in a frame of full stops that both sides compress alike; its gain is
the number of bytes that the toxic dictionary saves over the ordinary one.  Gains of windows that
repeat are kept in a bounded table per worker.  A document is described by shares and counts of windows
over gain thresholds, and a logistic calibration, fitted on the labelled sample, makes a score of them.  Words of
every whole text are looked at; label, language, source and doc_id are no inputs of a score.

Fitting reads a bounded sample: at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled rows (and ``MOST_CHARS`` characters of
each, for fitting only), chosen by a hash of the doc_id, so that any layout gives the same model.

Defined cases: null and empty texts and texts without letters get the score of no evidence; with no toxic or no
ordinary labelled rows the model is the share of toxic labels; repeated rows score alike; null doc_ids are never learnt
from; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

MOST_TOXIC = 2000
MOST_ORDINARY = 4000
MOST_CHARS = 20_000
ORDINARY_BYTES = 65_536
BEGINNING = 10
LEAST_SHARE = 0.01
LEAST_DOCS = 5
LEAST_RATIO = 20.0
LEVEL = 3
THRESHOLD = 0.3
KEPT_WORDS = 200_000
FRAME = b"." * 16
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def padded(word: str) -> bytes:
    return f" {word} ".encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Two raw dictionaries and the calibration: weights over standardised features, the last for the intercept."""
    toxic: bytes
    ordinary: bytes
    middle: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def key(self) -> str:
        return hashlib.sha256(repr((self.toxic, self.ordinary, self.middle, self.spread, self.weights)).encode()).hexdigest()


def features(gains: np.ndarray) -> list[float]:
    """What a document's windows show: counts and shares over thresholds, mean, most, how many."""
    words = len(gains)
    gains = gains if words else np.zeros(1)
    over = [(gains >= t).sum() for t in (2, 3, 4)]
    return [np.log1p(over[1]), np.log1p(over[0]), *(np.sqrt(n / len(gains)) for n in over), 100 * gains.mean(), gains.max(), np.log1p(words)]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.gains = model, {}
        self.sides = []
        for content in (model.toxic, model.ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False,
                                                       write_checksum=False, write_dict_id=False))

    def measured(self, word: str) -> int:
        window = FRAME + padded(word) + FRAME
        toxic, ordinary = (len(side.compress(window)) for side in self.sides)
        return ordinary - toxic

    def gain(self, word: str) -> int:
        known = self.gains.get(word)
        if known is None:
            if len(self.gains) > KEPT_WORDS:
                self.gains = {}
            known = self.gains[word] = self.measured(word)
        return known

    def score(self, text: str | None) -> float:
        m = self.model
        z = m.weights[-1]
        if m.middle:
            words = words_of(text)
            gains = np.fromiter(map(self.gain, words), np.float64, len(words))
            z += float(np.dot((np.array(features(gains)) - m.middle) / m.spread, m.weights[:-1]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the last column of ``x`` is one."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_segments(seen: np.ndarray, names: list[bytes], toxic: int, ordinary: int) -> list[bytes]:
    """Word beginnings that set toxic documents apart, the most frequent last.

    seen: documents that hold each of ``names``, in row 0 ordinary and in row 1 toxic ones, of so many each.
    """
    chosen = (seen[1] >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (seen[1] / toxic > LEAST_RATIO * (seen[0] + 0.5) / ordinary)
    return [s for _, s in sorted((int(seen[1, i]), names[i]) for i in np.flatnonzero(chosen))]


def _numbered(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """All different words, and each text as the numbers of its words."""
    number: dict[str, int] = {}
    coded = []
    for text in texts:
        words = words_of((text or "")[:MOST_CHARS])
        coded.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    return list(number), coded


def fit(sample: list[tuple[str | None, int]], odds: float | None = None) -> Model:
    """A model from (text, label) rows; runs where the bounded sample is.

    odds: toxic to ordinary rows among all labelled rows, where the sample holds another mixture.
    """
    y = np.array([int(label) for _, label in sample], dtype=np.int64)
    toxic, ordinary = int((y == 1).sum()), int((y == 0).sum())
    if not toxic or not ordinary:
        share = (toxic + 0.5) / (len(sample) + 1)
        return Model(b" ", b" ", weights=[float(np.log(share / (1 - share)))])
    words, coded = _numbered([t for t, _ in sample])
    names: dict[bytes, int] = {}
    beginning = np.array([names.setdefault(padded(w)[:BEGINNING], len(names)) for w in words], dtype=np.int64)
    seen = np.zeros((2, len(names)), dtype=np.int64)
    for text, label in zip(coded, y):
        seen[label, np.unique(beginning[text])] += 1
    segments = b"".join(toxic_segments(seen, list(names), toxic, ordinary))
    samples = [padded(words[i]) for text, label in zip(coded, y) if label == 0 for i in text[:400]][:100_000]
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        base = b"".join(samples)[-ORDINARY_BYTES:] or b" "
    model = Model(base + segments, base + bytes(len(segments)))
    scorer = Scorer(model)
    gains = np.array([scorer.measured(w) for w in words], dtype=np.float64)
    x = np.array([features(gains[text]) for text in coded])
    model.middle, model.spread = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    model.weights = _logistic(np.c_[(x - model.middle) / model.spread, np.ones(len(x))], y).tolist()
    if odds:
        model.weights[-1] += float(np.log(odds * ordinary / toxic))
    return model


def _learnable(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~_held_out(F.col("doc_id"))).distinct())


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = MOST_TOXIC, ordinary: int = MOST_ORDINARY) -> DataFrame:
    """``text, toxic`` of labelled rows outside the held-out fold, at most so many of each class, by a hash of doc_id."""
    known = _learnable(labels)
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(ordinary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, MOST_CHARS).alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")  # at most toxic + ordinary rows


def _held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_sample(docs, labels).collect()
    seen: dict[int, tuple[str | None, int]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"] or "")):
        seen.setdefault(r["doc_id"], (r["text"], r["toxic"]))
    counts = {r["toxic"]: r["count"] for r in _learnable(labels).groupBy("toxic").count().collect()}  # two rows
    odds = counts.get(1, 0) / counts[0] if counts.get(0) else None
    return fit(list(seen.values()), odds)


def _scorer(sent, key: str) -> Scorer:
    """One per worker process and model."""
    return common.held(f"toxicity {key}", lambda: Scorer(sent.value))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key()  # two dictionaries of bounded size

    def run(batches):
        scorer = _scorer(sent, key)
        for part in common.slices(batches):
            yield pa.record_batch({"doc_id": part.column(0), "score": pa.array([scorer.score(t) for t in common.texts(part)], pa.float64())})
    out = common.slim(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(docs, train(docs, labels), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; filtered where they lie, without a join."""
    model = train(docs, labels)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key()
    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(sent, key)
        for batch in batches:
            for part in common.slices([batch], batch.schema.field(at).name):
                yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
