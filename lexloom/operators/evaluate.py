"""Evaluation of retrieval: probe rows, recall, precision and reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default probes.
PROBES = [
    "responsible sharing framework consent withdrawal",
    "secondary use of genomic data limitations",
    "international data transfer safeguards",
    "security measures for genomic data",
    "participant transparency and recontact",
]
SNIPPETS, SNIPPET_CHARS, CARD_CHARS = 3, 240, 2000


def snippet(text, chars: int = SNIPPET_CHARS):
    return F.replace(F.substring(F.coalesce(text, F.lit("")), 1, chars), F.lit("\n"), F.lit(" "))


def probe_rows(hits: DataFrame) -> DataFrame:
    """``(query_id, hit_count, top_ids, snippets)`` of retrieved ``(query_id, place, id, text)``."""
    row = F.struct("place", "id", snippet(F.col("text")).alias("s"))
    each = hits.groupBy("query_id").agg(F.count("*").alias("hit_count"), F.sort_array(F.collect_list(row)).alias("rows"))
    return each.select("query_id", "hit_count", F.transform("rows", lambda x: x["id"]).alias("top_ids"), F.transform(F.slice("rows", 1, SNIPPETS), lambda x: x["s"]).alias("snippets"))


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """Per query of ``gold(query_id, id)``: recall and precision at ``k`` and the reciprocal rank of the
    first relevant hit; a query without hits scores 0."""
    wanted = gold.select("query_id", "id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    right = hits.where(F.col("place") < k).join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n_right"), F.min("place").alias("first"))
    return sizes.join(right, "query_id", "left").select(
        "query_id", (F.coalesce("n_right", F.lit(0)) / F.col("n_gold")).alias("recall_at_k"), (F.coalesce("n_right", F.lit(0)) / F.lit(k)).alias("precision_at_k"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("reciprocal_rank")
    )


#: Needles of one automaton; more are looked for in further passes.
NEEDLES = 100_000


def holding(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """``(query_id, id)``: which ``rows(id, text)`` hold which of ``needles(query_id, needle)`` word for word.

    One pass over the texts for all needles (Aho-Corasick), so the work doesn't grow with their number. Null
    texts hold nothing, null and empty needles are held by nothing.
    """
    asked = needles.where("needle <> ''")
    n = max(1, -(-asked.count() // NEEDLES))
    id_type, q_type = rows.schema["id"].dataType.simpleString(), needles.schema["query_id"].dataType.simpleString()
    parts = []
    for b in range(n):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "needle").toArrow()
        block = rows.sparkSession.sparkContext.broadcast((own.column("query_id").to_pylist(), own.column("needle").to_pylist()))

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            ids, words = block.value
            tree, of = ahocorasick.Automaton(), {}
            for q, w in zip(ids, words):
                of.setdefault(w, []).append(q)
            for w in of:
                tree.add_word(w, w)
            tree.make_automaton()
            for batch in batches:
                asked_by, row = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for w in {w for _, w in tree.iter(text)} if text and of else ():
                        asked_by += of[w]
                        row += [i] * len(of[w])
                yield pa.RecordBatch.from_arrays([pa.array(asked_by, own_type), batch.column(0).take(pa.array(row, pa.int64()))], names=["query_id", "id"])

        own_type = own.schema.field("query_id").type
        parts.append(rows.select("id", "text").mapInArrow(find, f"query_id {q_type}, id {id_type}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
