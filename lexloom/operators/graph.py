"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import staged, unstage

#: Rounds after which the contraction must have ended: each at least halves the nodes that still have edges.
MAX_ROUNDS = 64


def _mark(links: DataFrame) -> tuple:
    """Count and sums of two hashes of the distinct links: equal for equal tables, and else almost surely not."""
    h = [F.sum(F.shiftright(F.xxhash64(F.lit(salt), "u", "v"), 24)) for salt in (1, 2)]
    return tuple(links.agg(F.count("*"), *h).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component's id is its smallest node.

    Alternating star contraction: each round links all larger neighbours of a node to the smallest
    one (large star), then all smaller ones (small star), until nothing changes. Both steps are
    grouped minima, so a hub's edges are combined before the shuffle and never form one task's list.
    Null ends are dropped, self loops keep their node, repeated edges count once, and an empty table
    gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _mark(links)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        after = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = _mark(after)
        unstage(links)
        links, unchanged, before = after, now == before, now
        if unchanged:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
