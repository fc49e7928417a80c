"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rerank(ranked: DataFrame) -> DataFrame:
    """Ranks from 0 without gaps, per query and list, as after a filter."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_no").orderBy("rank")) - 1)


def fuse(ranked: DataFrame, top_n: int, k: int = K) -> DataFrame:
    """``(query_id, id, fused, place)`` from ``(query_id, list_no, rank, id)``: sums of 1 / (k + rank + 1).

    Ties go to what appears first: in the earlier list, then at the better rank. Places start at 0.
    """
    summed = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)), 12).alias("fused"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "first.list_no", "first.rank")
    return summed.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < top_n).select("query_id", "id", "fused", "place")
