"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces (whole documents, or 4096-token cuts of longer ones) are dealt by hash into shards of bounded size.
Each shard is evolved on several islands, one Spark group each.  An individual is a list of bins.  A crossover
injects whole well-filled bins of one parent into the other, removes the injected pieces from the other
parent's bins, and puts the displaced pieces back by best fit, largest first.  An island goes on until its packing meets the
lower bound or crossings bring nothing any more.  After each epoch the elite
of an island also goes to the next one (a shuffle of piece rows).  Of the islands of a shard the best packing stays.
Bins that are still poorly filled are opened, and their pieces are dealt and packed again, across shards.

Ids come from the library word by word: its pre-tokeniser never joins across ASCII white space, so the ids of
a text are those of its words in order.  Each worker keeps a bounded table from word to encoded ids, and a word that a slice repeats
is looked up once.

Defined cases: null and empty texts are one piece with the end id alone; equal lengths are kept apart by row order;
repeated rows are packed as often as they occur; no join is on doc_id, so null ids pass; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import os
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
PIECES_PER_SHARD = 2_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 3
#: Crossings in a row without a better packing after which an island stops; one that reaches the lower bound stops at once.
GENERATIONS = 20
WELL_FILLED = 0.995
KEPT_WORDS = 400_000
KEPT_LENGTH = 8
#: ASCII characters that are neither letters, digits nor white space (and no part of a special token's spelling).
TRAILING = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "<|>_")
#: Latin letters (one code point each in composed form, lower-cased to one of the small ones), as classes of a pattern.
LETTERS, SMALL = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", "a-z\u00DF-\u00F6\u00F8-\u00FF"
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Character of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


_gathered = lambda table, starts, lengths: table[np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)]


class WordIds:
    """Little-endian 32-bit ids of single words, as the library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.letters = _byte_letters()

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different ``words`` (strings), one after the other, and the number of each word's.

        The normaliser lower-cases and the pre-tokeniser parts letters from what follows, so a word of Latin letters with
        other characters after it is the ids of its letters and those of the rest; words differ mostly in these.
        """
        stem = pc.utf8_rtrim(words, characters=TRAILING)
        parted = pc.match_substring_regex(stem, f"^[{LETTERS}]+$")
        first = pc.if_else(parted, pc.utf8_lower(stem), words)
        tailed = pc.and_(parted, pc.not_equal(pc.binary_length(stem), pc.binary_length(words)))
        rests = pc.replace_substring_regex(words.filter(tailed), f"^[{LETTERS}]+", "")
        units = pa.chunked_array([first, rests]).combine_chunks().dictionary_encode()
        if isinstance(units, pa.ChunkedArray):
            units = units.combine_chunks()
        ids = self._units(units.dictionary)
        table, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, unit = np.cumsum(sizes) - sizes, units.indices.to_numpy(zero_copy_only=False)
        pairs = np.full((len(words), 2), -1, dtype=np.int64)
        pairs[:, 0] = unit[:len(words)]
        pairs[np.flatnonzero(tailed.to_numpy(zero_copy_only=False)), 1] = unit[len(words):]
        flat = pairs.ravel()
        lengths = np.where(flat >= 0, sizes[flat], 0)
        return _gathered(table, starts[flat], lengths), lengths.reshape(-1, 2).sum(axis=1)

    def _units(self, units: pa.Array) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:  # short ones are those that come again
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= KEPT_LENGTH}
            if len(self.known) > KEPT_WORDS // 2:
                self.known = {b"": b""}
        plain = units.cast(pa.binary()).to_pylist()
        out = list(map(self.known.get, plain))
        new = [k for k, ids in enumerate(out) if ids is None]
        if not new:
            return out
        letters = pc.match_substring_regex(units.take(pa.array(new)), f"^[{SMALL}]+$").to_pylist()
        tokenize, pack, whole = self.tokenizer.model.tokenize, struct.pack, []
        for k, simple in zip(new, letters):
            if not simple:
                whole.append(k)
                continue
            # small letters pass the normaliser and pre-tokeniser as they are
            text = plain[k].decode()
            ids = [t.id for t in tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]
            out[k] = pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(whole), 20_000):
            part = whole[at:at + 20_000]
            for k, found in zip(part, self.tokenizer.encode_batch_fast([plain[k].decode() for k in part], add_special_tokens=False)):
                ids = found.ids
                out[k] = pack(f"<{len(ids)}I", *ids)
        self.known.update((plain[k], out[k]) for k in new)
        return out


def _words(path: str) -> WordIds:
    return common.held(f"words {path}", lambda: WordIds(path))


def encoded(texts: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts in a row, and where each text's begin (one more entry than texts).

    Words are split, and equal ones found, in Arrow; only different words of the slice are looked up in Python.
    """
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    table, lengths = ids.of(words.dictionary)
    code = words.indices.to_numpy(zero_copy_only=False)
    size = lengths[code]
    ends = np.concatenate([[0], np.cumsum(size)])
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return _gathered(table, (np.cumsum(lengths) - lengths)[code], size), ends[np.concatenate([[0], np.cumsum(counts)])]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    path, end = path or tokenizer_path(), np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        ids = _words(path)
        for part in common.slices(batches):
            flat, edges = encoded(part.column(1), ids)
            out = []
            for row, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                coded = flat[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    cut = coded[at:at + 4 * capacity]
                    out.append((row, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            row, k, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*out))
            yield pa.record_batch({"doc_id": part.column(0).take(pa.array(row)), "piece": pa.array(k, pa.int64()).cast(pa.int32()),
                                   "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc)})
    return common.slim(docs).mapInArrow(run, PIECE_COLUMNS)


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put ``items``, largest first, where they leave the least room; open a bin where none has room."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for item in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect.bisect_left(free, (size[item], -1))
        if at < len(free):
            left, b = free.pop(at)
            bins[b].append(item)
        else:
            left, b = capacity, len(bins)
            bins.append([item])
            room.append(capacity)
        room[b] = left = left - size[item]
        if left:
            bisect.insort(free, (left, b))


def fill_by_pairs(size: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bin after bin: the largest piece left, then the pair (or piece) that fills the rest best.  Packs few large pieces a bin far better than best fit."""
    ids = np.argsort(np.asarray(size), kind="stable")
    left, bins, room = np.asarray(size, dtype=np.int64)[ids], [], []
    while len(left):
        bins.append([int(ids[-1])])
        rest = capacity - int(left[-1])
        left, ids = left[:-1], ids[:-1]
        while len(left) and left[0] <= rest:
            if left[-2:].sum() <= rest:
                taken = [len(left) - 1]
            else:
                fits = left[:np.searchsorted(left, rest, side="right")]
                other = np.searchsorted(left, rest - fits, side="right") - 1
                other -= other == np.arange(len(fits))
                total = np.where(other >= 0, fits + left[other], 0)
                one = int(np.argmax(total))
                taken = [one, int(other[one])] if total[one] > fits[-1] else [len(fits) - 1]
            bins[-1] += ids[taken].tolist()
            rest -= int(left[taken].sum())
            left, ids = np.delete(left, taken), np.delete(ids, taken)
        room.append(rest)
    return bins, room


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller and emptier bins rather than even ones."""
    return len(room), -sum((1 - r / capacity) ** 2 for r in room)


def cross(giver, taker, size: list[int], capacity: int, rng: random.Random):
    """Inject well-filled bins of ``giver`` into ``taker``; displaced pieces are best-fitted again."""
    bins, room = giver
    full = [b for b, r in enumerate(room) if r <= (1 - WELL_FILLED) * capacity] or sorted(range(len(room)), key=room.__getitem__)[:2]
    taken = rng.sample(full, max(1, len(full) // 2))
    injected = {i for b in taken for i in bins[b]}
    out, left, displaced = [list(bins[b]) for b in taken], [room[b] for b in taken], []
    for b, items in enumerate(taker[0]):
        if injected.isdisjoint(items) and taker[1][b] <= (1 - WELL_FILLED) * capacity:
            out.append(list(items))
            left.append(taker[1][b])
        else:
            displaced += [i for i in items if i not in injected]
    best_fit(out, left, displaced, size, capacity)
    return out, left


def evolve(size: list[int], capacity: int, seed: int, known: list, population: int = POPULATION, generations: int = GENERATIONS):
    """The best packing once it meets the lower bound or ``generations`` crossings in a row brought none better.

    ``known``: packings (lists of bins) to start from.
    """
    rng = random.Random(seed)
    pool = [(bins, [capacity - sum(size[i] for i in b) for b in bins]) for bins in known]
    bound = -(-sum(size) // capacity)
    while len(pool) < population:
        bins, room, order = [], [], list(range(len(size)))
        if not pool:
            best_fit(bins, room, order, size, capacity)
        elif len(pool) == 1:
            bins, room = fill_by_pairs(size, capacity)
        else:  # random groups first, so that individuals differ
            rng.shuffle(order)
            half = len(order) // 2
            for at in range(0, half, 500):
                best_fit(bins, room, order[at:min(at + 500, half)], size, capacity)
            best_fit(bins, room, order[half:], size, capacity)
        pool.append((bins, room))
        if len(room) <= bound:
            break
    pool.sort(key=lambda x: fitness(x[1], capacity))
    idle = 0
    while idle < generations and len(pool) > 1 and len(pool[0][1]) > bound:
        before = fitness(pool[0][1], capacity)
        a, b = rng.sample(range(len(pool)), 2)
        child = cross(pool[min(a, b)], pool[max(a, b)], size, capacity, rng)
        pool = sorted([*pool, child], key=lambda x: fitness(x[1], capacity))[:population]
        now = fitness(pool[0][1], capacity)
        idle = 0 if now[0] < before[0] or now[0] == before[0] and now[1] < before[1] - 1e-9 else idle + 1
    return pool[0]


def _island(capacity: int):
    """One group: the pieces of a shard on an island, with the bins of the packings that came in (``origin``)."""
    def run(key, rows):
        shard, island = int(key[0]), int(key[1])
        rows = rows.sort_values(["origin", "doc_id", "piece", "start", "length", "ids_crc32", "row"], kind="stable")
        own = rows[rows["origin"] == rows["origin"].iloc[0]].sort_values("row", kind="stable").reset_index(drop=True)
        size, known = own["length"].tolist(), []
        for _, one in rows[rows["bin"] >= 0].groupby("origin"):
            one = one.sort_values("row", kind="stable")
            bins: dict[int, list[int]] = {}
            for item, b in enumerate(one["bin"].tolist()):
                bins.setdefault(b, []).append(item)
            known.append(list(bins.values()))
        bins, room = evolve(size, capacity, 7919 * shard + island, known)
        place, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                place[i], offset[i] = b, at
                at += size[i]
        return own.assign(island=island, bin=place, offset=offset, bins=len(bins), room=[room[b] for b in place])
    return run


def _pack_level(items: DataFrame, rows: int, level: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """Evolve every shard on its islands; piece rows with shard, bin, offset, room of the best island."""
    shards = common.spread_count(rows, PIECES_PER_SHARD)
    columns = f"{PIECE_COLUMNS}, row long, shard long, origin int, island int, bin long, offset long, bins long, room long"
    now = (items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
           .withColumn("bin", F.lit(-1).cast("long")).withColumn("origin", F.lit(0))
           .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))))
    names = [c.split()[0] for c in columns.split(", ")]
    for epoch in range(epochs):
        if epoch:  # the elite stays, and goes to the next island as well
            migrants = now.withColumn("origin", F.lit(1)).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            now = now.withColumn("origin", F.lit(0)).unionByName(migrants)
        now = now.withColumns({"offset": F.lit(0).cast("long"), "bins": F.lit(0).cast("long"), "room": F.lit(0).cast("long")})
        now = common.durable(now.select(names).groupBy("shard", "island").applyInPandas(_island(capacity), columns))
    best = now.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", F.col("best.island").alias("island"))
    return now.join(best, ["shard", "island"])


def pack(parts: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Piece rows with sequence_id and offset; parts: the columns of ``pieces``."""
    parts = common.durable(parts.withColumn("row", F.monotonically_increasing_id()))
    full, rest = parts.where(F.col("length") >= capacity), parts.where(F.col("length") < capacity)
    done = [full.select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    for level in (0, 1, 2):
        rows = rest.count()
        if not rows and level:
            break
        placed = _pack_level(rest, rows, level, capacity, islands, epochs)
        named = placed.withColumn("sequence_id", F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 24) + F.col("bin"))
        last = level == 2 or rows <= PIECES_PER_SHARD
        poor = F.lit(False) if last else F.col("room") > (1 - WELL_FILLED) * capacity
        done.append(named.where(~poor).select(*parts.columns, "sequence_id", "offset"))
        if last:
            break
        rest = named.where(poor).select(*parts.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)
