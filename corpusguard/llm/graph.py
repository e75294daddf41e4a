"""Connected components by alternating stars; only edges of two columns move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import discard, store


def _sum(edges: DataFrame) -> tuple:
    # A sum over 32 bits of a hash can't overflow a long.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "label").bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node of edges (a, b).

    Each round hangs larger neighbours onto the least one, then does so among smaller
    ones, until no edge changes.  A node's least neighbour is found with partial
    aggregation, and given to its edges by a join that can be split where a node is hot.
    """
    stars = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).distinct(),
        "stars",
    )
    before = _sum(stars)
    while True:
        both = stars.union(stars.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.least(F.min("label"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("label > node").select(F.col("label").alias("node"), F.col("least").alias("label"))
        large = store(large.distinct(), "stars")
        older = stars
        floor = large.groupBy("node").agg(F.min("label").alias("least"))
        small = large.join(floor, "node")
        stars = store(
            small.where("label <> least")
            .select(F.col("label").alias("node"), F.col("least").alias("label"))
            .union(floor.select("node", F.col("least").alias("label")))
            .where("node <> label")
            .distinct(),
            "stars",
        )
        discard(older, large)
        now = _sum(stars)
        if now == before:
            break
        before = now
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
