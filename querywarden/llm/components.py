"""Connected components by alternating stars; nothing but counts and a checksum reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import stored

ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """Each ``u`` with the least of itself and its neighbours ``v``."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a``, ``b``: long): the root is its component's least node.

    Large-star and small-star steps in turn; they keep the components and end in stars. Each round is
    stored, so a lost executor costs one round.
    """
    now, before = stored(_edges(edges), "components"), None
    for _ in range(ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        large = _edges(both.join(_star(both), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        linked = down.join(_star(down), "u")
        small = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(linked.select(F.col("u"), F.col("m")))
        now = stored(_edges(small), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
