"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document is its set of five-word shingles, hashed once.  The hashes are dealt over ``BINS`` bins by their top bits
and the smallest of each bin is kept: one pass over the set in place of one hash function a position.  An empty bin takes
the value of the first filled one in a random order of its own (optimal densification), which keeps the chance that two
sets agree in a bin at their similarity.  Bands of ``ROWS`` bins are bucket keys; a pair at similarity 0.85 shares one
of the 32 bands with a chance of 0.99996.

Equal sets are one node.  In every bucket each node is paired with the smallest one only (a star), so candidates
grow with the nodes and not with the pairs; every star edge is verified on the full sets.  What stars leave open is
settled apart: buckets that still hold several components after the stars are compared in blocks, first by their bin values,
then by sketches of their smallest hashes (the whole set, for most documents), each pair in the first band that it shares.
Only pairs across components that the sketches take for similar leave their task, and are verified on the full sets as
well.  So a link between two members that are both far from the centre of their bucket is not lost.

Texts travel once for each verified edge: the members of a star are cut into blocks and each block gets its centre.  Texts and
sketches that no edge needs are held back by a Bloom filter before they are shuffled.

Defined cases: null and empty texts and texts of white space have an empty set and are linked with nothing, not even one
another; fewer than five words are one shingle; repeated rows and equal doc_ids are linked like any other; a null doc_id
stays a row and takes the smallest doc_id of its component (null where there is none; such rows count as kept); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom, common
from tidemark.llm.components import components

SHINGLE = 5
PERCENT = 85
BINS = 256
ROWS = 8
BANDS = BINS // ROWS
BLOCK = 1024
MEMBERS = 64
#: A sketch holds the smallest hashes of a set, 32 bits each: the whole of most sets.
SKETCH = 1024
#: Standard deviations below the threshold at which the agreement of two signatures rules a pair out.
DEVIATIONS = 6.0
_ORDER = np.argsort(common.mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BINS, BINS), axis=1)
_WEIGHTS = common.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_STEPS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text."""
    split = [raw.lower().split() for raw in raws]  # bytes: ASCII letters and white space only
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for words in split for w in words), np.uint64, int(sizes.sum()))
    five = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=np.uint64)
    for k, step in enumerate(_STEPS):
        five += common.mix(hashes[k:k + len(five)] + step) * step
    five = common.mix(five)
    out, at = [], 0
    for words, n in zip(split, sizes.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(five[at:at + n - SHINGLE + 1]))
        else:
            out.append(np.array([digest(b" ".join(words), 5)] if n else [], dtype=np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified bin minima of a set that is not empty."""
    first = np.searchsorted(shingles, _EDGES)
    found = np.minimum(first, len(shingles) - 1)
    filled = (first < len(shingles)) & (shingles[found] >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
    out = shingles[found]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    mixed = common.mix(sig.reshape(BANDS, ROWS)) * _WEIGHTS
    return common.mix(mixed.sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def marked_rows(docs: DataFrame) -> DataFrame:
    """Per row: row, doc_id, n_shingles, digest of the set, bands, signature (a byte a bin), sketch (smallest hashes), text."""
    rows = common.slim(docs).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for part in common.slices(batches):
            sets, digests, bands, prints, sketches = shingle_sets(common.raw_texts(part)), [], [], [], []
            for s in sets:
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s) if len(s) else np.zeros(0, np.uint64)
                bands.append(common.signed(band_keys(sig)) if len(s) else np.zeros(0, np.int64))
                prints.append(common.mix(sig).astype(np.uint8).tobytes())
                sketches.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.record_batch({
                "row": part.column(2), "doc_id": part.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array(digests, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                "print": pa.array(prints, pa.binary()), "sketch": pa.array(sketches, pa.binary()), "text": part.column(1)})

    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, bands array<long>, print binary, sketch binary, text string")


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def verified(edges: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``edges(a, b)`` whose full shingle sets are similar enough; texts: row, text."""
    per_hub = edges.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    dealt = common.durable(edges.join(per_hub, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block")))
    centres = dealt.select("b", "block").distinct().select("b", "block", F.lit(None).cast("long").alias("a"), F.col("b").alias("row"))
    wanted = dealt.select("b", "block", "a", F.col("a").alias("row")).unionByName(centres)

    def run(batches):
        centre, key = None, None
        for part in common.slices(batches, limit=common.SLICE_BYTES):
            left, right = [], []
            for b, block, a, shingles in zip(*(part.column(k).to_pylist() for k in range(3)), shingle_sets(common.raw_texts(part))):
                if a is None:
                    centre, key = shingles, (b, block)
                elif key == (b, block):
                    small, large = sorted((centre, shingles), key=len)
                    at = np.searchsorted(large, small)
                    shared = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if similar(shared, len(small), len(large), percent):
                        left.append(a)
                        right.append(b)
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    texts = bloom.only(texts, "row", wanted.select(F.col("row").alias("key")))
    return (wanted.join(texts, "row").select("b", "block", "a", "text").repartition("b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("a"))
            .mapInArrow(run, "a long, b long"))


def _least_agreement(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bins that two similar sets of at least ``sizes`` shingles agree in, but for ``DEVIATIONS`` standard deviations.

    A set much smaller than the bins fills each several times, so its shingles count, not its bins.
    """
    share = percent / 100
    free = np.minimum(BINS, np.maximum(sizes, 1)) / 2
    return BINS * (share - DEVIATIONS * np.sqrt(share * (1 - share) / free))


def _may_be_similar(one: np.ndarray, two: np.ndarray, sizes: tuple[int, int], percent: int) -> bool:
    """Whether two sketches leave a link possible: exact where both hold their whole set, else but for ``DEVIATIONS`` standard deviations."""
    if max(sizes) > SKETCH:
        most = min(s[-1] for s, n in zip((one, two), sizes) if n > SKETCH)
        one, two = one[one <= most], two[two <= most]
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    at = np.searchsorted(large, small)
    shared = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small)) if len(large) else 0
    if max(sizes) <= SKETCH:
        return similar(shared, *sizes, percent)
    union, share = len(small) + len(large) - shared, percent / 100
    return shared >= (share - DEVIATIONS * (share * (1 - share) / max(union, 1)) ** 0.5) * union


def _open_pairs(percent: int):
    """Pairs inside the groups of a partition sorted by (key, pair); a group never spans two yields."""
    def run(parts):
        held = None

        def pairs(rows):
            group = np.flatnonzero(np.concatenate([[True], (rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1]) | (
                rows["pair"].to_numpy()[1:] != rows["pair"].to_numpy()[:-1]), [True]]))
            prints = np.frombuffer(b"".join(rows["print"]), dtype=np.uint8).reshape(-1, BINS)
            sketch = [np.frombuffer(raw, dtype=np.uint32) for raw in rows["sketch"]]
            node, label, size, centre, own, pair, band = (rows[c].to_numpy(np.int64) for c in ("node", "label", "n_shingles", "centre", "own", "pair", "band"))
            left, right = [], []
            for start, end in zip(group[:-1], group[1:]):
                one_block = pair[start] >> 32 == pair[start] & 0xFFFFFFFF
                for x in range(start, end - 1):
                    rest = slice(x + 1, end)
                    low, high = np.minimum(size[x], size[rest]), np.maximum(size[x], size[rest])
                    good = (label[rest] != label[x]) & (100 * low >= percent * high) & (node[rest] != centre[x]) & (node[x] != centre[x])
                    if not one_block:
                        good &= own[rest] != own[x]
                    y = np.flatnonzero(good)
                    equal = prints[y + x + 1] == prints[x]
                    near = np.count_nonzero(equal, axis=1) >= _least_agreement(low[y], percent)
                    # a pair is judged in the first band that it shares
                    near &= ~equal.reshape(-1, BANDS, ROWS)[:, :band[x]].all(axis=2).any(axis=1)
                    for k in (y[near] + x + 1).tolist():
                        if _may_be_similar(sketch[x], sketch[k], (int(size[x]), int(size[k])), percent):
                            left.append(max(node[x], node[k]))
                            right.append(min(node[x], node[k]))
            return pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            last = (rows["key"] == rows["key"].iloc[-1]) & (rows["pair"] == rows["pair"].iloc[-1])
            held, ready = rows[last], rows[~last]
            if len(ready):
                yield pairs(ready)
        if held is not None and len(held):
            yield pairs(held)

    return run


def open_pairs(buckets: DataFrame, labels: DataFrame, marked: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: pairs of one bucket in different components that the star has not judged and the sketches do not rule out.

    marked: row, n_shingles, print, sketch, of every node at least.
    """
    named = labels.select("node", F.col("component").alias("label"))
    rows = buckets.where("members > 2").join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = common.durable(rows)
    several = rows.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("key")
    rows = common.durable(rows.join(several, "key"))
    held = bloom.only(marked.select(F.col("row").alias("node"), "n_shingles", "print", "sketch"), "node", rows.select(F.col("node").alias("key")))
    rows = rows.join(held, "node")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = (rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))))
    pair = F.least("own", "other").cast("long") * (1 << 32) + F.greatest("own", "other")
    rows = rows.select("key", "band", pair.alias("pair"), "own", "node", "label", "centre", "n_shingles", "print", "sketch")
    return (rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
            .mapInPandas(_open_pairs(percent), "a long, b long").distinct())


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    marked = common.durable(marked_rows(docs))
    # bands come along with the smallest row of each set, so no join has to fetch them
    classes = common.durable(marked.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min_by("bands", "row").alias("bands")))
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1")
    buckets = common.durable(keyed.join(hubs, "key"))
    texts = marked.select("row", "text")
    stars = buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = common.durable(verified(stars, texts, percent))
    found = components(links)
    rest = common.durable(open_pairs(buckets, found, marked, percent))
    if not rest.isEmpty():
        more = common.durable(verified(rest, texts, percent))
        if not more.isEmpty():
            found = components(links.unionByName(more))
    labelled = classes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "label").select("digest", "component_id")
    rows = marked.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    return rows.join(ids, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
