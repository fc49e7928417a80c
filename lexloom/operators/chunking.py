"""Overlapping windows of texts, their ids and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import blank_to_null, strip, unified_newlines

SIZE, OVERLAP = 900, 150


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of 0-based window starts of a stripped text; none for an empty one.

    A window of ``size`` code points begins every ``size - overlap`` (at least 1); the first that reaches
    the end is the last. Closed form, no loop: 1 + ceil(max(n - size, 0) / step) windows.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    step = max(size - overlap, 1)
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def overlap_chunks(df: DataFrame, keep: list[str], text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` with ``window_ix, start, chunk_text``: a row per window, in one narrow stage."""
    body = df.select(*keep, strip(unified_newlines(F.col(text_col))).alias("__body"))
    each = body.select(*keep, "__body", F.posexplode(windows(F.col("__body"), size, overlap)).alias("window_ix", "start"))
    return each.select(*keep, "window_ix", "start", F.substring("__body", F.col("start") + 1, F.lit(size)).alias("chunk_text"))


def file_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of ``pages(path, page, text, category, jurisdiction, document_id, framework[, doc_no])``.

    The chunk index runs on across a file's pages; the id holds the file's base name, 12 digits of the
    SHA-256 of its path, page and index. The category defaults to the file's stem; blank metadata is null.
    With ``doc_no``, the number of the file in its store, rows have their place ``ord`` (doc_no * 2^32 + index)
    and ``jurisdictions``, as the chunk store wants them. Only windows of one file are ordered: a window by path.
    """
    placed = "doc_no" in pages.columns
    keep = ["path", "page", "category", "jurisdiction", "document_id", "framework", *(["doc_no"] if placed else [])]
    parts = overlap_chunks(pages, keep, "text", size, overlap)
    order = Window.partitionBy("path").orderBy("page", "window_ix")
    base = F.element_at(F.split("path", "/"), -1)
    code = F.upper(strip(blank_to_null(F.col("jurisdiction"))))
    more = [(F.col("doc_no").cast("bigint") * (1 << 32) + F.col("chunk_ix")).alias("ord"), F.when(code.isNotNull(), F.array(code)).alias("jurisdictions")] if placed else []
    return parts.withColumn("chunk_ix", F.row_number().over(order) - 1).select(
        F.concat(base, F.lit("_"), F.substring(F.sha2("path", 256), 1, 12), F.lit("_p"), F.col("page"), F.lit("_c"), F.col("chunk_ix")).alias("id"),
        F.col("chunk_text").alias("text"), base.alias("source"), F.col("path").alias("source_path"), F.col("page").cast("bigint").alias("page"), "chunk_ix",
        F.coalesce(blank_to_null(F.col("category")), F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).alias("category"),
        code.alias("jurisdiction"), blank_to_null(F.col("document_id")).alias("document_id"), blank_to_null(F.col("framework")).alias("framework"), *more,
    )
