"""Evidence blocks within a budget, and chat contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip

MAX_CHARS, HISTORY = 12_000, 24


def pack(ranked: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(query_id, n_chunks, used_chars, evidence)`` from ``(query_id, place, id, text, source, page, category)``.

    A block is a header line, the stripped text and a line end; blocks join with a further line end. The
    first block that would exceed the budget ends the pack (separators are not counted); a query whose first
    block does has empty evidence.
    """
    header = F.concat(F.lit("[chunk_id="), F.col("id"), F.lit(" source="), F.coalesce("source", F.lit("?")), F.lit(" page="), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit(" category="), F.coalesce("category", F.lit("?")), F.lit("]"))
    block = F.concat(header, F.lit("\n"), strip(F.coalesce("text", F.lit(""))), F.lit("\n"))
    order = Window.partitionBy("query_id").orderBy("place")
    fits = F.col("used") <= max_chars
    used = ranked.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order))
    kept = F.sort_array(F.collect_list(F.when(fits, F.struct("place", "block"))))
    return used.groupBy("query_id").agg(
        F.count_if(fits).alias("n_chunks"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("used_chars"),
        strip(F.array_join(F.transform(kept, lambda x: x["block"]), "\n")).alias("evidence"),
    )


def chat_history(messages: DataFrame, last: int = HISTORY) -> DataFrame:
    """Of ``messages(conv_id, turn, role, text)`` the ``last`` of each conversation, and of those the ones
    by user or assistant with some text, stripped."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= last)
    return recent.select("conv_id", "turn", "role", strip("text").alias("text")).where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def chat_prompt(evidence: DataFrame, consents: DataFrame, history: DataFrame) -> DataFrame:
    """Messages ``(conv_id, turn, role, text)`` for a generator: one system message with the evidence, the
    study kind and the consent text (turn -1), then the history. The call itself is pluggable."""
    from lexloom.operators.classify import study_type

    system = consents.join(evidence, consents["conv_id"] == evidence["query_id"], "left").select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit("STUDY_TYPE_GUESS: "), study_type(F.col("text")), F.lit("\n\nPOLICY EXCERPTS:\n"), F.coalesce("evidence", F.lit("")), F.lit("\n\nCONSENT_OR_DATA_USE_TEXT:\n"), strip(F.coalesce("text", F.lit("")))).alias("text"),
    )
    return system.unionByName(history.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text"))
