"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH, exact edit verification.

A document contains a benchmark item if some run of its words lies within ``floor(0.2 n)`` word edits of the item's n
words (similarity 0.8 or more), letters in either case and punctuation aside.

1. Item-sized windows are placed where they can match at all: ``e`` edits leave one of ``e + 1`` disjoint parts of an
   item intact (pigeonhole), so every match contains such a part, and windows start where a part puts the item, shifted
   by up to e words either way.  This step loses nothing.
2. The CGK random walk reads a word sequence with a pointer that a random bit of (step, word) moves on or not; it
   maps edit distance to Hamming distance.  Each repetition has a walk of its own and samples a few of its steps; a
   window that agrees with the item in all samples of one repetition is a candidate.  The number of repetitions is set
   from the agreement measured on items edited as far as allowed, so that the target recall is reached.  Where that takes
   more than ``MOST_REPEATS`` (long items), every window of step 1 is a candidate.
3. Candidates are verified by the exact edit distance of the item to the best run of words around the window.

The benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters (or one item); documents are passed over once
per block, so a large benchmark costs passes, not memory.

Defined cases: null and empty texts and items contain and match nothing; an item repeated under several ids matches under each;
rows of a repeated doc_id are judged one by one; texts are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

EDIT_SHARE = 0.2
TARGET_RECALL = 0.999
SAMPLES = 2
MOST_REPEATS = 64
BLOCK_CHARS = 4_000_000
STEPS_PER_WORD = 3
#: ASCII upper case to lower case, ASCII characters other than letters and digits to a space.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_GRAMS = common.Rolling(0x8EBC6AF09C88C6E3)


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN)


def most_edits(n: int) -> int:
    return int(EDIT_SHARE * n + 1e-9)


def walk(words: np.ndarray, steps: int, seed: int, at: np.ndarray) -> np.ndarray:
    """CGK embedding of the rows of ``words`` (m, n), read at the sampled steps ``at`` only: (m, len(at))."""
    m, n = words.shape
    padded = np.concatenate([words, np.zeros((m, 1), dtype=np.uint64)], axis=1)
    pointer, rows = np.zeros(m, dtype=np.int64), np.arange(m)
    out, wanted = np.zeros((m, len(at)), dtype=np.uint64), {int(s): k for k, s in enumerate(at)}
    for step in range(min(steps, int(at.max()) + 1)):
        word = padded[rows, pointer]
        if step in wanted:
            out[:, wanted[step]] = word
        salt = np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) & common.MASK)
        pointer = np.minimum(pointer + (common.mix(word ^ salt) >> np.uint64(63)).astype(np.int64), n)
    return out


def sampled_steps(n: int, seed: int, samples: int = SAMPLES) -> np.ndarray:
    """Steps of repetition ``seed`` for items of n words; the walk passes an item in two steps a word on average."""
    return np.sort(np.random.default_rng([n, seed]).choice(max(samples, 2 * n), size=samples, replace=False))


def agreement(words: np.ndarray, tries: int = 40) -> float:
    """Share of embedded positions that agree between an item and itself edited as far as allowed."""
    n, rng = len(words), np.random.default_rng(len(words))
    edited = []
    for _ in range(tries):
        now = words.tolist()
        for _ in range(most_edits(n)):
            kind, at = rng.integers(3), int(rng.integers(max(1, len(now))))
            new = int(rng.integers(1, 1 << 62))
            if kind == 0 and now:
                now[at] = new
            elif kind == 1:
                now.insert(at, new)
            elif len(now) > 1:
                now.pop(at)
        edited.append((now + [0] * n)[:n])
    steps = np.arange(2 * n)
    one = walk(words[None, :], STEPS_PER_WORD * n, 1, steps)
    return float((walk(np.array(edited, dtype=np.uint64), STEPS_PER_WORD * n, 1, steps) == one).mean())


def needed_repeats(rate: float) -> int:
    """Repetitions that reach the target recall at this agreement; 0 where there would be too many and all windows are verified."""
    missed = 1 - min(0.999, rate ** SAMPLES)
    needed = max(4, math.ceil(math.log(1 - TARGET_RECALL) / math.log(missed))) if missed < 1 else math.inf
    return needed if needed <= MOST_REPEATS else 0


@dataclass
class Items:
    """A block of the benchmark: words, seeds (part hash to item and offset) and embeddings per repetition."""
    ids: list[int]
    words: list[np.ndarray]
    repeats: dict[int, int] = field(default_factory=dict)  # by item length; 0: no walk
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # part length, hash
    embedded: dict[int, list[np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Items:
        hashes, counts = common.hash_words([plain(t) for _, t in rows])
        ends = np.cumsum(counts)
        kept = [(i, hashes[e - c:e]) for (i, _), e, c in zip(rows, ends, counts) if c]
        out = Items([i for i, _ in kept], [w for _, w in kept])
        for n in sorted({len(w) for w in out.words}):
            same = [w for w in out.words if len(w) == n]
            out.repeats[n] = needed_repeats(min(agreement(w, max(8, 200 // len(same))) for w in same))
        for k, words in enumerate(out.words):
            n = len(words)
            size = n // (most_edits(n) + 1)
            starts = np.arange(most_edits(n) + 1) * size
            found = _GRAMS.digest(_GRAMS.sums(words), starts, starts + size)
            for at, h in zip(starts.tolist(), found.tolist()):
                out.seeds.setdefault(size, {}).setdefault(h, []).append((k, at))
        for n, repeats in out.repeats.items():
            same = [k for k, words in enumerate(out.words) if len(words) == n]
            together = np.array([out.words[k] for k in same])
            for r in range(repeats):
                for k, own in zip(same, walk(together, STEPS_PER_WORD * n, r, sampled_steps(n, r))):
                    out.embedded.setdefault(k, []).append(own)
        return out

    def lookups(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per part length a small bitmap over the top bits of the hashes, and the sorted hashes."""
        out = {}
        for size, table in self.seeds.items():
            keys = np.array(sorted(table), dtype=np.uint64)
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[(keys >> np.uint64(44)).astype(np.int64)] = True
            out[size] = (bitmap, keys)
        return out


def edits_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the run of ``region`` nearest to ``item``, by words; any start and end."""
    row, ladder = np.zeros(len(region) + 1, dtype=np.int64), np.arange(len(region) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ladder) + ladder
    end = int(row.argmin())
    return int(row[end]), end


class Finder:
    def __init__(self, items: Items):
        self.items, self.lookups = items, items.lookups()

    def windows(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """Item to (document, start) of the windows that a part puts there."""
        out: dict[int, set[tuple[int, int]]] = {}
        sums = _GRAMS.sums(hashes)
        for size, (bitmap, keys) in self.lookups.items():
            if len(hashes) < size:
                continue
            at = np.arange(len(hashes) - size + 1)
            found = _GRAMS.digest(sums, at, at + size)
            at = at[bitmap[(found >> np.uint64(44)).astype(np.int64)]]
            at = at[np.isin(found[at], keys)]
            docs = np.searchsorted(last, at, side="right")
            inside = at + size <= last[docs] if len(at) else np.zeros(0, bool)
            for p, d in zip(at[inside].tolist(), docs[inside].tolist()):
                for k, offset in self.items.seeds[size][int(found[p])]:
                    out.setdefault(k, set()).add((d, p - offset))
        return out

    def candidates(self, k: int, placed: set[tuple[int, int]], hashes: np.ndarray, first, last) -> set[tuple[int, int]]:
        """Those (document, start) of ``placed`` that have a window, shifted by up to e words, that agrees with item k."""
        words = self.items.words[k]
        n, e = len(words), most_edits(len(words))
        if not self.items.repeats[n]:
            return placed
        spots, shifts, held = sorted(placed), np.arange(-e, e + 1), set()
        for at in range(0, len(spots), 2_000):
            part = spots[at:at + 2_000]
            of = np.repeat(np.arange(len(part)), len(shifts))
            docs = np.array([d for d, _ in part])[of]
            index = (np.array([s for _, s in part])[:, None] + shifts).reshape(-1, 1) + np.arange(n)
            outside = (index < first[docs][:, None]) | (index >= last[docs][:, None])
            window = np.where(outside, np.uint64(0), hashes[np.clip(index, 0, len(hashes) - 1)])
            agreed = np.zeros(len(part), dtype=bool)
            for r, own in enumerate(self.items.embedded[k]):
                rest = np.flatnonzero(~agreed[of])
                if not len(rest):
                    break
                seen = walk(window[rest], STEPS_PER_WORD * n, r, sampled_steps(n, r))
                agreed[of[rest[(seen == own).all(axis=1)]]] = True
            held.update(part[i] for i in np.flatnonzero(agreed).tolist())
        return held

    def matches(self, raws: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, distance, start, words) of every row and item that match; the best run of each."""
        hashes, counts = common.hash_words(raws)
        last = np.cumsum(counts)
        first, best = last - counts, {}
        for k, placed in self.windows(hashes, first, last).items():
            words = self.items.words[k]
            n, e = len(words), most_edits(len(words))
            done: dict[int, int] = {}
            for d, start in sorted(self.candidates(k, placed, hashes, first, last)):
                if start < done.get(d, -1 << 62):  # inside the region just verified
                    continue
                low, high = max(first[d], start - 2 * e), min(last[d], start + n + 3 * e + 1)
                done[d] = start + e + 1
                distance, end = edits_within(words, hashes[low:high])
                if distance <= e:
                    back, length = edits_within(words[::-1], hashes[low:low + end][::-1])
                    found = (distance, int(low + end - length - first[d]), length)
                    best[d, k] = min(best.get((d, k), found), found)
        return [(d, self.items.ids[k], *found) for (d, k), found in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Not a list of all items: a generator of bounded blocks, each read when its pass begins."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = common.spread_count(total, BLOCK_CHARS)
    for b in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]  # a bounded block


def _finder(sent, key: str) -> Finder:
    return common.held(f"items {key}", lambda: Finder(sent.value))


def _sent(docs: DataFrame, rows):
    return docs.sparkSession.sparkContext.broadcast(Items.of(rows)), str(hash(tuple(rows)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` and item in it: doc_id, item_id, edits, similarity, start (word), n_words."""
    out = None
    for rows in blocks(benchmark):
        sent, key = _sent(docs, rows)

        def run(batches, sent=sent, key=key):
            finder = _finder(sent, key)
            for part in common.slices(batches):
                found = finder.matches([plain(t) for t in common.texts(part)])
                if found:
                    row, item, edits, start, words = (pa.array(c, pa.int64()) for c in zip(*found))
                    yield pa.record_batch({"doc_id": part.column(0).take(row), "item_id": item, "edits": edits, "start": start, "n_words": words})
        one = common.slim(docs).mapInArrow(run, "doc_id long, item_id long, edits long, start long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item; filtered where they lie, without a join."""
    at = docs.columns.index("text")
    for rows in blocks(benchmark):
        sent, key = _sent(docs, rows)

        def run(batches, sent=sent, key=key):
            finder = _finder(sent, key)
            for batch in batches:
                for part in common.slices([batch], batch.schema.field(at).name):
                    raws = [plain(t) for t in part.column(at).to_pylist()]
                    bad = {m[0] for m in finder.matches(raws)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
