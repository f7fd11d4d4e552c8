"""Hard negatives, MinHash near-duplicates and collocations against plain versions, on awkward rows and small tables."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tidemark.llm import common, exact_dedup, hard_negatives, minhash, phrases, substring_dedup

PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all that noise today".split()


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(50)) for _ in range(n))


def edited(seed, text, changes):
    rng, words = random.Random(seed), text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(words)


# ------------------------------------------------------------------ MinHash

def plain_groups(rows):
    sets = []
    for _, text in rows:
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    out = []
    for k, (i, _) in enumerate(rows):
        top = min((rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None), default=None)
        out.append((i, len(sets[k]), top, i == top))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def near_rows():
    base, other = passage(1, 300), passage(2, 60)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b\tC d"), (8, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"),
            (None, base), (None, passage(7, 50)), (None, None), (10, base.upper()), (11, "same " * 500), (12, "same " * 400), (13, "é" * 20_000)]
    rows += [(100 + k, edited(k, base, 1 + k % 7)) for k in range(40)]
    rows += [(200 + k, edited(k, other, 1)) for k in range(20)]
    # a chain: neighbours are similar, the ends are not; none is the centre of all buckets
    chain = passage(3, 400).split()
    for k in range(12):
        rows.append((300 + (k * 7) % 12, " ".join(chain)))
        for at in range(k * 8, k * 8 + 5):
            chain[at] = f"link{k}x{at}"
    rng = random.Random(4)
    rng.shuffle(rows)
    return rows


def test_near_groups(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in "row digest node label key a b block component centre members print bands least kept".split()}).repartition(3)
    got = minhash.near_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_groups(near_rows)


def test_small_blocks_change_nothing(spark, near_rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "MEMBERS", 2)
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in minhash.near_groups(docs).collect()) == plain_groups(near_rows)


def test_links_that_no_star_holds(spark):
    """Of one bucket, two nodes similar to one another but not to the centre are paired; pairs of the centre and of one component are not."""
    sets = [np.unique(np.random.default_rng(s).integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)) for s in range(3)]
    twin = sets[1].copy()
    twin[:20] = np.random.default_rng(9).integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = [minhash.common.mix(minhash.signature(np.unique(s))).astype(np.uint8).tobytes() for s in (sets[0], sets[1], twin, sets[2])]
    sketches = [(np.unique(s) >> np.uint64(32)).astype(np.uint32).tobytes() for s in (sets[0], sets[1], twin, sets[2])]
    nodes = spark.createDataFrame([(k, 600, bytearray(p), bytearray(s)) for k, (p, s) in enumerate(zip(prints, sketches))],
                                  "row long, n_shingles long, print binary, sketch binary")
    # the first band that two prints share
    same = (np.frombuffer(prints[1], np.uint8) == np.frombuffer(prints[2], np.uint8)).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)
    buckets = spark.createDataFrame([(5, k, int(same.argmax()), 4, 0) for k in range(4)], "key long, node long, band int, members long, centre long")
    labels = lambda rows: spark.createDataFrame(rows, "node long, component long")
    assert [tuple(r) for r in minhash.open_pairs(buckets, labels([]), nodes).collect()] == [(2, 1)]
    assert minhash.open_pairs(buckets, labels([(1, 1), (2, 1)]), nodes).count() == 0


def test_sketches_of_large_sets(monkeypatch):
    rng = np.random.default_rng(6)
    union = np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2))
    sketch = lambda s: (np.sort(s)[:minhash.SKETCH] >> np.uint64(32)).astype(np.uint32)
    for share, want in ((0.95, True), (0.86, True), (0.7, False), (0.3, False)):
        rng.shuffle(union)
        gone = int((1 - share) * len(union) / 2)
        a, b = union[gone:], union[:len(union) - gone]
        assert minhash._may_be_similar(sketch(a), sketch(b), (len(a), len(b)), 85) == want


def test_signatures_agree_at_the_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((3000, 0.85), (300, 0.85), (40, 0.9), (3000, 0.5)):
        agree, found = [], 0
        for _ in range(60):
            union = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64))
            rng.shuffle(union)
            gone = round((1 - share) * len(union) / 2)
            a, b = np.sort(union[gone:]), np.sort(union[:len(union) - gone])
            one, two = minhash.signature(a), minhash.signature(b)
            agree.append(np.mean(one == two))
            found += bool(set(minhash.band_keys(one).tolist()) & set(minhash.band_keys(two).tolist()))
        assert abs(np.mean(agree) - share) < 0.04 and (share < 0.8 or found == 60)


# ------------------------------------------------------------------ hard negatives

def plain_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        kept.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = []
    last = lambda v: (v is None, v)
    for a, (vec_id, q, label) in enumerate(kept):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, other[1])), other[0], b, other[2]) for b, other in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            fit = [s for s in scored if s[3] != label and 30 * score <= 100 * s[0] <= 90 * score][:10]
            out += [(vec_id, positive, rank, s[1], score, s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(map(repr, out))


def vectors(seed, n, width, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(k, (centres[rng.integers(6)] + 0.4 * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(labels))) for k in range(n)]


def run_negatives(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in "row shard anchor q tree".split()})
    out = hard_negatives.hard_negatives(df.repartition(3))
    assert dict(out.dtypes)["rank"] == "int" and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in out.collect())


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 8 * 12 * 100)  # several cells and shards
    rows = vectors(1, 900, 12)
    rows += [(2000 + k, None, 1) for k in range(2)] + [(2100, [1.0] * 12, None), (2200, [1.0, None] * 6, 1), (2300, [float("nan")] * 12, 2), (2400, [float("inf")] * 12, 2)]
    rows += [(2500, [0.0] * 12, 1), (2600, [], 2), (2700, [0.5] * 5, 3), (None, [0.5] * 12, 3), (-100, [0.25] * 12, 0)]
    assert run_negatives(spark, rows) == plain_negatives(rows)


def test_hard_negatives_with_ties_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 8 * 3 * 64)
    same = [(k, [0.5, 0.25, 1.0], k % 3) for k in range(300)]
    assert run_negatives(spark, same + [(k, v[:3], l) for k, v, l in vectors(2, 900, 3)[300:]]) == plain_negatives(
        same + [(k, v[:3], l) for k, v, l in vectors(2, 900, 3)[300:]])
    assert run_negatives(spark, same) == plain_negatives(same)


def test_hard_negatives_of_huge_components(spark):
    rows = [(k, [1e9 * (k % 5), 3e10, 7.0 * k], k % 2) for k in range(0, 400, 4)]
    assert run_negatives(spark, rows) == []  # all scores are cut to the largest number, which is over 90 % of itself
    rows = [(k, [2e5 * (k % 5), 3e6, 7.0 * k], k % 2) for k in range(0, 400, 5)]  # beyond 2**53, within 64 bits
    assert run_negatives(spark, rows) == plain_negatives(rows)


def test_trees_cover_their_points():
    rng = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(1, 8)), 100, axis=0)]))
    tree = hard_negatives.build(points, np.arange(500), np.arange(500), np.zeros(500, np.int64))
    assert sorted(tree.rows.tolist()) == list(range(500)) and not tree.leaf[0]
    unit = np.column_stack([tree.points, np.sqrt(np.maximum(tree.top ** 2 - (tree.points ** 2).sum(axis=1), 0))]) / tree.top

    def below(node):
        return list(range(tree.first[node], tree.last[node])) if tree.leaf[node] else [
            i for child in range(tree.first[node], tree.last[node]) for i in below(child)]

    angle = np.arctan2(tree.sine, tree.cosine)
    for node in range(len(tree.leaf)):
        inside = below(node)
        apart = np.arccos(np.clip(unit[inside] @ unit[tree.centre[node]], -1, 1))
        assert (apart <= angle[node] + 1e-7).all() and tree.centre[node] in inside
        if not tree.leaf[node]:
            children = range(tree.first[node], tree.last[node])
            assert all(angle[c] <= angle[node] / hard_negatives.SHRINK + 1e-6 for c in children)
    seen = []
    q = points[3]
    search = hard_negatives.Search(tree, q, tree.points[tree.centre] @ q, lambda at: seen.extend(at) or np.ones(len(at), bool), np.array([0]), np.array([2 ** 40]), 3)
    best = search.run()[0][1].tolist()
    assert best == sorted((points @ q).astype(int).tolist(), reverse=True)[:3] and len(seen) < 500


# ------------------------------------------------------------------ collocations

def plain_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {w: a for w, a in f.items() if a >= least}
        scored = []
        for w, a in f.items():
            if len(w) < 2 or any(b >= a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in f.items() if len(v) > len(w)):
                continue
            score, k = min((Fraction(1000 * a * totals[lang], f[w[:k]] * f[w[k:]]).__floor__(), k) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = "of the in a to by on at with from".split()
    rows = [(k, "en" if k % 3 else None, " ".join(rng.choice(common) for _ in range(80)) + ", Prime Minister of\tthe land. New  York; é ß\x0bnew york! ") for k in range(60)]
    rows += [(None, "en", None), (None, "en", ""), (70, "de", " .;\n"), (71, "de", "x" * 20_000), (72, "en", "all in one row " * 200), (72, "en", "all in one row " * 200)]
    return rows


@pytest.mark.parametrize("percent", [20, 100, 0])
def test_collocations(spark, texts, percent):
    """With a sample of everything, of a part, and of nothing: the border then fails for every frequent phrase."""
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string").withColumns(
        {c: F.lit(1) for c in "key phrase n draw a l r k w".split()}).repartition(3)
    got = phrases.collocations(docs, least=20, top=40, percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(texts, 20, 40)


def test_border_failures_are_found(spark, texts):
    """A phrase concentrated in one row that the sample leaves out fails the border, and the expansion counts what holds it."""
    rows = [(k, "en", "some other words here") for k in range(400)] + [(1000, "en", "a rare phrase of five here. " * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for percent in (1, 30):
        known, totals = phrases.frequent_phrases(docs, 100, percent)
        got = {r.phrase: r.n for r in known.collect()}
        assert got["a rare phrase of five"] == got["rare phrase of five here"] == 150 and got["here"] == 550 and got["some other words here"] == 400
        assert [tuple(r) for r in totals.collect()] == [("en", 400 * 4 + 150 * 6)]


def test_products_beyond_64_bits(spark, monkeypatch):
    known = [("x", "a", 10 ** 12), ("x", "b", 10 ** 12), ("x", "a b", 10 ** 12 - 1)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (spark.createDataFrame(known, "lang string, phrase string, n long"),
                                                                  spark.createDataFrame([("x", 10 ** 14)], "lang string, n long")))
    row = phrases.collocations(None).first()
    assert row.score == 1000 * (10 ** 12 - 1) * 10 ** 14 // 10 ** 24


def test_empty_tables(spark):
    assert minhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


# ------------------------------------------------------------------ substring dedup by row

def plain_cuts(rows, window=50):
    """Row by row: rows of equal (or no) id never remove from each other, and a missing id is larger than any."""
    words = [brute.raw_words(t) for _, t in rows]
    order = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(order, words):
        for at in range(len(w) - window + 1):
            key = tuple(w[at:at + window])
            first[key] = min(first.get(key, float("inf")), i)
    out = []
    for (doc, _), i, w in zip(rows, order, words):
        gone = np.zeros(len(w), dtype=bool)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < i:
                gone[at:at + window] = True
        out.append((doc, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(map(repr, out))


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    a, b, c = passage(50, 60), passage(51, 60), passage(52, 80)
    thue = "".join("01"[bin(k).count("1") & 1] for k in range(512))
    one, two = passage(53, 49), "".join("10"[int(x)] for x in thue)
    rows = [(1, a), (None, a), (None, b), (7, a), (7, c), (7, c), (8, c + " " + b), (None, None), (9, b), (3, one + " " + thue), (4, one + " " + two),
            (20, " " + a + " \t\n"), (21, ""), (None, "x " + c)]
    got = substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got.collect()) == plain_cuts(rows)
    many = [(None if k % 3 else 5, f"{passage(60 + k % 7, 55)} {passage(90 + k, 20)}") for k in range(120)] + [(2, passage(60, 55))]
    got = substring_dedup.cut_repeats(spark.createDataFrame(many, "doc_id long, text string"))
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got.collect()) == plain_cuts(many)


def test_word_hashes():
    import xxhash
    raws = [b"", b"  a b\x0bc \t", "é 中文\x85x\x1cy".encode(), b"a", b" \n ", b"same same"]
    hashes, counts = common.hash_words(raws)
    assert counts.tolist() == [len(r.split()) for r in raws]
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for r in raws for w in r.split()]
    assert [len(x) for x in common.hash_words([])] == [0, 0]


# ------------------------------------------------------------------ removal from the exact index

def test_index_counts_what_it_removes(spark):
    """Removing some rows of a class leaves the others; the last one takes the class along, and shards may end empty."""
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (4, "c"), (5, "d")]
    found = lambda some: exact_dedup.digests(spark.createDataFrame(some, "doc_id long, text string"))
    state = lambda index: {(r.keep_id, r.group_size) for r in exact_dedup.live(index).collect()}
    index = common.durable(exact_dedup.build(found(rows), 3))
    assert state(index) == {(1, 3), (3, 1), (4, 2), (5, 1)}
    gone, left = rows[:1] + rows[3:4] + rows[5:6], rows[1:3] + rows[4:5] + rows[6:]
    less = common.durable(exact_dedup.update(index, found(gone), 3, remove=True, left=found(left)))
    assert state(less) == {(2, 2), (None, 1), (5, 1)}
    none = common.durable(exact_dedup.update(less, found(left), 3, remove=True))
    assert state(none) == set() and state(exact_dedup.update(none, found(rows), 3)) == state(index)
    assert state(exact_dedup.update(index, found(gone), 3, remove=True)) == {(None, 2), (None, 1), (5, 1)}
