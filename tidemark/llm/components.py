"""Connected components of a link table, by alternating large and small stars over written tables.

Each round every node links its larger neighbours (large star), then its smaller ones (small star), to the
smallest node it knows.  Links become stars after a number of rounds that grows with the logarithm of
the nodes.  The driver sees one number per round, never links or labels.  A node with very many links is no
hot group: its smallest neighbour is a partial aggregate, and the rows join back with it as they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

MAX_ROUNDS = 60


def _directed(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a > b).  Large: every larger neighbour of a node; small: the node and its smaller neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node."""
    now = common.durable(_directed(links))
    before = None
    for _ in range(MAX_ROUNDS):
        now = common.durable(_star(_star(now, True), False))
        # done when the links are stars and stay so: the same number and the same sum of hashes twice running
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
