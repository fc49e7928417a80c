"""Hybrid retrieval: dense and lexical candidates, filters, fusion, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import codes, is_blank
from lexloom.operators.dense import knn_topk
from lexloom.operators.fusion import fuse, rerank
from lexloom.operators.lexical import Index, bm25_topk

TOP_K, POOL = 8, 24


def passes(category: str | None = None, jurisdictions: list[str] | None = None) -> Column:
    """Filter on chunk metadata: category case-insensitive, any common jurisdiction; an untagged chunk fails a jurisdiction filter."""
    keep = F.lit(True)
    if category:
        keep = keep & F.coalesce(F.lower("category") == category.lower(), F.lit(False))
    wanted = [c.strip().upper() for c in jurisdictions or [] if c and c.strip()]
    if wanted:
        keep = keep & F.coalesce(F.arrays_overlap(codes(F.col("jurisdictions")), F.array(*map(F.lit, dict.fromkeys(wanted)))), F.lit(False))
    return keep


def hybrid_retrieve(queries: DataFrame, store: DataFrame, vectors: DataFrame, index: Index, *, top_k: int = TOP_K, category: str | None = None, jurisdictions: list[str] | None = None, pool: int = POOL, dim: int = 64) -> DataFrame:
    """``(query_id, place, id, fused)`` and the chunk's columns: the best ``top_k`` chunks of every query.

    ``queries(query_id, text, embedding)``; ``store`` has one row per chunk id with ``ord``; ``vectors(id, ord,
    embedding)``, one row an id; ``index`` is the store's BM25 index. Filters apply after each list was cut to
    ``pool`` candidates, and ranks are counted anew, so a narrow filter may return fewer rows; to filter before,
    hand in a store, vectors and an index of the wanted chunks only. Blank queries return nothing; an empty store
    returns nothing. Texts are read for the final rows only.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    asked = queries.where(~is_blank(F.col("text")))
    dense = knn_topk(asked.select("query_id", "embedding"), vectors, pool, dim).select("query_id", F.lit(0).alias("list_no"), "rank", "id")
    lexical = bm25_topk(asked.select("query_id", "text"), index, pool).select("query_id", F.lit(1).alias("list_no"), "rank", "id")
    lists = dense.unionByName(lexical)
    if category or jurisdictions:
        lists = rerank(lists.join(store.where(passes(category, jurisdictions)).select("id"), "id", "left_semi"))
    best = fuse(lists, 3 * top_k).where(F.col("place") < top_k)
    return best.join(store, "id")
