"""Hard negatives by exact inner-product search in cover trees over norm-augmented vectors.

One more component, sqrt(M^2 - |x|^2) with M the longest norm of a tree, puts all vectors on one sphere and leaves inner products
with an anchor (0 in that component) as they are.  A cover tree over the sphere halves, about, its covering radius
from level to level.  A node's centre and radius bound the inner products of all vectors below it by the angle between
anchor and centre, widened by the node's own angle.  The descent takes the nodes with the highest bounds first, skips nodes whose bounds lie
outside all score windows or under the last of the best rows so far, and computes the scores of leaves exactly.

Rows are dealt to the nearest of at most ``PIVOTS`` sampled rows and each cell is cut into shards of about ``SHARD_BYTES`` of components; every shard is one tree,
one written row.  Anchors pass all shards, in tasks that hold one tree and stream the anchors; the best rows of each shard are merged.
Bounds carry a margin for rounding, and scores are whole numbers, exact in doubles while they stay under 2^53; beyond that
a shard computes them as whole numbers of any size and cuts them to 64 bits.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; an empty vector, and the missing components of a
shorter one, count as zeros; a repeated row is a row of its own (an anchor repeated gives its rows twice); ties go to the smaller vec_id, a null vec_id
last, then to the earlier row; a negative positive score leaves its window empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
PIVOTS = 256
SHARD_BYTES = 2_000_000
LEAF = 16
SHRINK = 1.4
BATCH = 64
#: Anchors whose products with a tree's centres are computed at once.
TOGETHER = 128
NO_ID = np.iinfo(np.int64).max
_LONG = np.iinfo(np.int64)


def quantised(rows: DataFrame) -> DataFrame:
    """``row, vec_id, label, q, square``: the rows that take part, with whole components and their squared norm."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                       label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("q"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(3)
            values, offsets = np.floor(256.0 * q.flatten().to_numpy(zero_copy_only=False)), q.offsets.to_numpy() - q.offsets[0].as_py()
            square = np.array([float(values[a:b] @ values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            yield pa.record_batch({"row": batch.column(0), "vec_id": batch.column(1), "label": batch.column(2),
                                   "q": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), "square": pa.array(square)})

    return kept.mapInArrow(run, "row long, vec_id long, label long, q array<double>, square double")


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


# ------------------------------------------------------------------ trees

@dataclass
class Tree:
    """Points in leaf order and nodes: centre (a point), cosine and sine of their angle, range of points (leaves) or of child nodes."""
    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    centre: np.ndarray
    cosine: np.ndarray
    sine: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: float

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as held:
            return cls(**{k: float(v) if k == "top" else v for k, v in held.items()})


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Tree:
    """A cover tree by greedy nets: children of a node are more than its radius / ``SHRINK`` apart and cover its points within that."""
    square = (points * points).sum(axis=1)
    top = float(np.sqrt(square.max())) if len(points) else 0.0
    augmented = np.column_stack([points, np.sqrt(np.maximum(top * top - square, 0.0))])
    if top:
        augmented /= top

    def far(centre: int, among: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(augmented[among] @ augmented[centre], -1.0, 1.0)) if top else np.zeros(len(among))

    everything = np.arange(len(points))
    start = int(np.argmax(augmented @ augmented.mean(axis=0))) if len(points) else 0
    nodes, queue, order, placed = [], [(start, everything, far(start, everything))], [], 0
    at = 0
    while at < len(queue):
        centre, members, apart = queue[at]
        radius = float(apart.max()) if len(members) else 0.0
        at += 1
        if len(members) <= LEAF or radius <= 1e-7:
            nodes.append((centre, radius, True, placed, placed + len(members)))
            order.append(members)
            placed += len(members)
            continue
        begun = len(queue)
        reach, child = radius / SHRINK, centre
        while len(members):
            near = (apart <= reach) | (members == child)
            queue.append((child, members[near], apart[near]))
            members = members[~near]
            if len(members):
                child = int(members[0])
                apart = far(child, members)
        nodes.append((centre, radius, False, begun, len(queue)))
    order = np.concatenate(order) if order else everything
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    centre, angle, leaf, first, last = (np.array(c) for c in zip(*nodes))
    angle = np.minimum(angle + 1e-7, np.pi)
    return Tree(points[order], ids[order], rows[order], labels[order], place[centre], np.cos(angle), np.sin(angle), leaf, first, last, top)


def _span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of some ranges."""
    sizes = last - first
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _whole(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of any size, cut to 64 bits."""
    whole = np.array([[int(v) for v in p] for p in points], dtype=object).reshape(points.shape)
    return np.clip(whole @ np.array([int(v) for v in q], dtype=object), _LONG.min, _LONG.max).astype(np.int64)


class Search:
    """The best rows of one tree for one anchor, for several score windows at once.

    ``dots``: inner products of the anchor with the centres of all nodes.
    """

    def __init__(self, tree: Tree, q: np.ndarray, dots: np.ndarray, take, low: np.ndarray, high: np.ndarray, most: int):
        self.tree, self.q, self.dots, self.take, self.most = tree, q, dots, take, most
        self.low, self.high, self.floor = low, high, low.astype(float)
        self.scale = float(np.sqrt(q @ q)) * tree.top
        self.best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in low]

    def bounds(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product below each node: the cosine of the angle to its centre, less and plus its own."""
        scale, slack = self.scale, 1e-9 * self.scale + 1e-6
        if not scale:
            return np.full(len(nodes), -slack), np.full(len(nodes), slack)
        near, cosine, sine = np.clip(self.dots[nodes] / scale, -1.0, 1.0), self.tree.cosine[nodes], self.tree.sine[nodes]
        along, across = near * cosine, np.sqrt(1.0 - near * near) * sine
        return (scale * np.where(near <= -cosine, -1.0, along - across) - slack,
                scale * np.where(near >= cosine, 1.0, along + across) + slack)

    def verify(self, at: np.ndarray, score: np.ndarray) -> None:
        good = self.take(at)
        at, score = at[good], score[good]
        for w, (low, high) in enumerate(zip(self.low.tolist(), self.high.tolist())):
            inside = (score >= max(low, self.floor[w])) & (score <= high)
            if not inside.any():
                continue
            i, s = np.concatenate([self.best[w][0], at[inside]]), np.concatenate([self.best[w][1], score[inside]])
            order = np.lexsort((self.tree.rows[i], self.tree.ids[i], -s))[:self.most]
            self.best[w] = [i[order], s[order]]
            if len(order) == self.most:
                self.floor[w] = max(low, s[order[-1]])

    def run(self) -> list[list[np.ndarray]]:
        t, nodes = self.tree, np.zeros(1, np.int64)
        lower, upper = self.bounds(nodes)
        while len(nodes):
            needed = np.zeros(len(nodes), dtype=bool)
            for low, high in zip(self.floor.tolist(), self.high.tolist()):
                if low <= high:
                    needed |= (lower <= high) & (upper >= low)
            nodes, lower, upper = nodes[needed], lower[needed], upper[needed]
            if not len(nodes):
                break
            later = np.ones(len(nodes), dtype=bool)
            later[np.argpartition(-upper, BATCH)[:BATCH] if len(nodes) > BATCH else slice(None)] = False
            chosen = nodes[~later]
            leaves, inner = chosen[t.leaf[chosen]], chosen[~t.leaf[chosen]]
            if len(leaves):
                at = _span(t.first[leaves], t.last[leaves])
                self.verify(at, np.rint(t.points[at] @ self.q).astype(np.int64))
            children = _span(t.first[inner], t.last[inner])
            below, above = self.bounds(children)
            nodes = np.concatenate([nodes[later], children])
            lower, upper = np.concatenate([lower[later], below]), np.concatenate([upper[later], above])
        return self.best

    def all(self) -> list[list[np.ndarray]]:
        """Every point, with whole numbers of any size: for components so large that doubles would not do."""
        self.floor = np.full(len(self.low), -np.inf)
        self.verify(np.arange(len(self.tree.points)), _whole(self.tree.points, self.q))
        return self.best


def search(tree: Tree, asks: list[dict], same: bool, most: int) -> list[list[list[np.ndarray]]]:
    """The best rows for some anchors; their products with all centres are one matrix product."""
    q = _matrix([ask["q"] for ask in asks], tree.points.shape[1])
    size = np.abs(tree.points).max(initial=0)
    dots, out = q @ tree.points[tree.centre].T, []
    for k, ask in enumerate(asks):
        take = lambda at, a=ask: ((tree.labels[at] == a["label"]) == same) & (tree.rows[at] != a["anchor"])
        one = Search(tree, q[k], dots[k], take, np.array(ask["low"], np.int64), np.array(ask["high"], np.int64), most)
        out.append(one.all() if q.shape[1] * size * np.abs(q[k]).max(initial=0) >= 2 ** 53 else one.run())
    return out


# ------------------------------------------------------------------ Spark

def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """``shard, tree``: one written tree a shard, shards numbered from 0; and their number."""
    n, top, width = rows.agg(F.count("*"), F.max("square"), F.max(F.size("q"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "shard long, tree binary"), 0
    per_shard = max(64, SHARD_BYTES // (8 * max(width, 1)))
    wanted = max(1, min(PIVOTS, n // per_shard))
    pivots = [list(r.q) for r in rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("q").collect()]
    pivot = _matrix(pivots, width)
    lift = np.sqrt(np.maximum(top - (pivot * pivot).sum(axis=1), 0.0))

    def nearest(batches):
        for batch in batches:
            points = _matrix(batch.column(3).to_pylist(), width)
            own = np.sqrt(np.maximum(top - batch.column(4).to_numpy(), 0.0))
            cell = np.argmax(points @ pivot.T + np.outer(own, lift), axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    placed = common.durable(rows.mapInArrow(nearest, "row long, vec_id long, label long, q array<double>, square double, cell long"))
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS
    parts = [common.spread_count(sizes.get(c, 0), per_shard) for c in range(len(pivots))]
    first = [sum(parts[:c]) for c in range(len(pivots))]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("cell") + 1).cast("int"))
    dealt = placed.withColumn("shard", (of(first) + F.pmod(F.xxhash64("row"), of(parts))).cast("long"))

    def grow(key, part):
        part = part.sort_values("row", kind="stable")
        tree = build(_matrix(part["q"].tolist(), width), part["vec_id"].to_numpy(np.int64), part["row"].to_numpy(np.int64), part["label"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "tree": [tree.dump()]})

    named = dealt.withColumn("vec_id", F.coalesce("vec_id", F.lit(int(NO_ID))))
    trees = named.select("shard", "row", "vec_id", "label", "q").groupBy("shard").applyInPandas(grow, "shard long, tree binary")
    return common.durable(trees), sum(parts)


_FOUND = "anchor long, place int, row long, vec_id long, score long"


def _passed(trees: DataFrame, shards: int, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """Every anchor through every tree: the best rows of each shard for each of the anchor's windows.

    anchors: anchor (row), label, q, low and high (arrays, one entry a window).
    """
    if not shards:
        return trees.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    asks = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    none = lambda kind: F.lit(None).cast(kind)
    names = ["shard", "anchor", "label", "q", "low", "high", "tree"]
    heads = trees.select("shard", none("long").alias("anchor"), none("long").alias("label"), none("array<double>").alias("q"),
                         none("array<long>").alias("low"), none("array<long>").alias("high"), "tree")
    rows = asks.withColumn("tree", none("binary")).select(names).unionByName(heads)

    def run(batches):
        tree, shard = None, None
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(5)]
            for key, group in groupby(batch.to_pylist(), key=lambda one: one["shard"]):
                asks = []
                for one in group:
                    if one["tree"] is not None:
                        tree, shard = Tree.load(one["tree"]), key
                    elif shard == key:
                        asks.append(one)
                for at in range(0, len(asks), TOGETHER):
                    some = asks[at:at + TOGETHER]
                    for ask, best in zip(some, search(tree, some, same, most)):
                        for place, (point, score) in enumerate(best):
                            columns = (np.full(len(point), ask["anchor"]), np.full(len(point), place), tree.rows[point], tree.ids[point], score)
                            for k, column in enumerate(columns):
                                out[k].append(column)
            anchor, place, row, ids, score = (np.concatenate(c) for c in out)
            yield pa.record_batch([pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(row), pa.array(ids, mask=ids == NO_ID), pa.array(score)],
                                  names=["anchor", "place", "row", "vec_id", "score"])

    found = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("anchor")).mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of an anchor's rows with another label, those with low % to high % of the positive's score, the highest first.
    """
    table = common.durable(quantised(rows))
    trees, shards = index(table)
    anchors = table.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q")
    bound = lambda v: F.array(F.lit(int(v)).cast("long"))
    first = _passed(trees, shards, anchors.withColumns({"low": bound(_LONG.min), "high": bound(_LONG.max)}), True, positives)
    first = common.durable(first.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                        F.col("score").alias("positive_score")))
    wide = F.col("positive_score").cast("decimal(20,0)")
    windows = first.withColumns({"lo": F.ceil(wide * low / 100).cast("long"), "hi": F.floor(wide * high / 100).cast("long")})
    windows = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("w")).select(
        "anchor", F.col("w.lo").alias("low"), F.col("w.hi").alias("high"))
    found = _passed(trees, shards, anchors.join(windows, "anchor"), False, negatives)
    named = found.select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (named.join(first, ["anchor", "place"]).join(anchors.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
