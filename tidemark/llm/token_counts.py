"""Exact token counts of every prefix of a text, by dynamic programming over its segments.

A piece of the vocabulary never holds white space after other characters and never a line feed (checked when
the model is loaded), so no merge crosses the start of a run of spaces or a line feed.  A text therefore
splits into segments that encode independently, and ``count(prefix k) = count(prefix k - 1) + tokens(segment k)``
is exact at the end of every segment.  Inside a segment the same recurrence runs over characters: the last
token of a prefix is the one piece that is valid next to the last token of what stands before it, so one table
holds the last token and the count of every prefix (``inside``).  Truncation and budget questions read
these tables and never encode a text again.

Segments repeat, so each worker keeps a bounded table of segment counts; what is missing is encoded by
the library in one call per slice.

Defined cases: null text is empty and has no tokens; long texts go through whole; rows are answered one by one, so
repeated rows and null doc_ids come out as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
KEPT_SEGMENTS = 400_000
BLOCK = "▁"
_SEGMENTS = re.compile(r"\n| *[^ \n]+| +")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Counter:
    """Segment counts and in-segment prefix tables of one sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                self.pieces.add(self.model.id_to_piece(i))
        crossing = [p for p in self.pieces if BLOCK in p.lstrip(BLOCK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross segments, so prefix counts would not add up: {crossing[:5]}")
        self.longest = max(map(len, self.pieces))
        self.counts: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text with the model's leading space, cut where no piece can cross; empty for an empty text."""
        return _SEGMENTS.findall(" " + text.replace(BLOCK, " ")) if text else []

    def learn(self, segments: set[str]) -> None:
        """Make the counts of all ``segments`` known."""
        if len(self.counts) > KEPT_SEGMENTS:
            self.counts = {}
        new = [s for s in segments if s not in self.counts]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            # a line feed in front shields the segment from the leading space: two tokens, which are taken off
            for s, ids in zip(part, self.model.encode(["\n" + s for s in part], num_threads=1)):
                self.counts[s] = len(ids) - 2

    def pieces_of(self, text: str) -> list[str]:
        return self.model.encode("\n" + text, out_type=str)[2:]

    def _fits(self, left: str, right: str) -> bool:
        """Whether the library leaves these two tokens standing side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            both = [p.replace(BLOCK, " ") for p in self.pieces_of(left + right)]
            known = self.pairs[left, right] = both == [left, right]
            if len(self.pairs) > KEPT_SEGMENTS:
                self.pairs = {}
        return known

    def inside(self, segment: str) -> list[int]:
        """Exact token count of every prefix of a segment: entry i is that of its first i characters."""
        last: list[str | None] = [None]
        counts = [0]
        for end in range(1, len(segment) + 1):
            char = segment[end - 1]
            if char.replace(" ", BLOCK) not in self.pieces:  # spelt in bytes; nothing merges with it
                last.append(None)
                counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
                continue
            for start in range(max(0, end - self.longest), end):
                token = segment[start:end]
                if token.replace(" ", BLOCK) not in self.pieces:
                    continue
                before = last[start]
                if self.count_alone(token) == 1 and (before is None or self._fits(before, token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends the prefix {segment[:end]!r}")
        return counts

    def count_alone(self, segment: str) -> int:
        if segment not in self.counts:
            self.learn({segment})
        return self.counts[segment]

    def table(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(end, count) of every segment prefix: characters of the text, tokens."""
        n = len(segments)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, n)) - 1  # without the leading space
        return ends, np.cumsum(np.fromiter(map(self.counts.__getitem__, segments), np.int64, n))

    def count_at(self, text: str, chars: int) -> int:
        """Exact count of the first ``chars`` characters, from the tables."""
        if not text or chars <= 0:
            return 0
        segments = self.segments(text)
        self.learn(set(segments))
        ends, counts = self.table(segments)
        k = int(np.searchsorted(ends, chars, side="left"))
        if k == len(ends):
            return int(counts[-1])
        if ends[k] == chars:
            return int(counts[k])
        before, at = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, -1)
        return before + self.inside(segments[k])[chars - at]

    def cut(self, segments: list[str], ends: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, int]:
        """(characters, tokens) of the longest prefix with at most ``budget`` tokens.

        Counts at segment ends grow, and a prefix that ends beyond segment k holds more tokens than k ends
        with, so only the first segment that exceeds the budget has to be looked into.
        """
        k = int(np.searchsorted(counts, budget, side="right"))
        chars, tokens = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
        if k < len(segments):
            base = int(ends[k - 1]) if k else -1
            for i, n in enumerate(self.inside(segments[k])):
                if tokens_of(counts, k) + n <= budget and base + i >= chars:
                    chars, tokens = base + i, tokens_of(counts, k) + n
        return (chars, tokens) if chars > 0 else (0, 0)


def tokens_of(counts: np.ndarray, k: int) -> int:
    return int(counts[k - 1]) if k else 0


def _counter(path: str) -> Counter:
    """One per worker process and model."""
    return common.held(f"counter {path}", lambda: Counter(path))


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and the prefix table ``ends`` (characters) with ``counts`` (tokens)."""
    path = path or model_path()

    def run(batches):
        counter = _counter(path)
        for part in common.slices(batches):
            whole = common.texts(part)
            cut = [counter.segments(t) for t in whole]
            counter.learn(set().union(*cut))
            tables = [counter.table(c) for c in cut]
            yield pa.record_batch({
                "doc_id": part.column(0), "n_bytes": pa.array([len(t.encode()) for t in whole], pa.int64()),
                "n_tokens": pa.array([int(c[-1]) if len(c) else 0 for _, c in tables], pa.int64()),
                "ends": pa.array([e.astype(np.int32) for e, _ in tables], pa.list_(pa.int32())),
                "counts": pa.array([c.astype(np.int32) for _, c in tables], pa.list_(pa.int32()))})
    return common.slim(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ends array<int>, counts array<int>")


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """Per row: doc_id, the longest prefix with at most ``budget`` tokens, its n_tokens, and ``cut``: is it shorter."""
    path = path or model_path()

    def run(batches):
        counter = _counter(path)
        for part in common.slices(batches):
            whole = common.texts(part)
            found = []
            for text in whole:
                segments = counter.segments(text)
                counter.learn(set(segments))
                found.append(counter.cut(segments, *counter.table(segments), budget))
            yield pa.record_batch({
                "doc_id": part.column(0), "text": pa.array([t[:n] for t, (n, _) in zip(whole, found)], pa.string()),
                "n_tokens": pa.array([k for _, k in found], pa.int64()),
                "cut": pa.array([n < len(t) for t, (n, _) in zip(whole, found)], pa.bool_())})
    return common.slim(docs).mapInArrow(run, "doc_id long, text string, n_tokens long, cut boolean")


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit; read off the last entry of the prefix table."""
    table = prefix_table(docs, path)
    total = F.when(F.size("counts") > 0, F.element_at("counts", -1)).otherwise(0).cast("long")
    return table.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
