"""Exact cosine top-k of stated query vectors against a vector table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL = 24
#: Query vectors that are sent to every task at once; more are compared block by block with shares of the vectors.
BLOCK, SHARE = 4096, 200_000


class Embedder(Protocol):
    """What turns texts into vectors: a model behind a name. It is sent to the tasks, so it must pickle."""

    name: str
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One row of ``dim`` values a text."""


def embed(rows: DataFrame, embedder: Embedder, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``embedding`` (unit length; null for a null or blank text) and ``embedder``."""
    schema = rows.select(*keep).schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", embedding array<float>, embedder string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            vectors: list = [None] * len(texts)
            if full:
                x = np.asarray(embedder([texts[i] for i in full]), np.float64).reshape(len(full), embedder.dim)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                for i, v in zip(full, (x / np.where(size > 0, size, 1)).astype(np.float32)):
                    vectors[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.name] * len(texts))], names=[*keep, "embedding", "embedder"])

    return rows.select(*keep, text_col).mapInArrow(run, out)


def usable(vectors: DataFrame, vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """Rows whose vector has ``dim`` finite values, not all zero."""
    v = F.col(vector_col)
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & (F.size(v) == dim)).where(sound)


def knn_topk(queries: DataFrame, vectors: DataFrame, k: int = POOL, dim: int = 64) -> DataFrame:
    """``(query_id, id, ord, score, rank)`` for ``queries(query_id, embedding)`` and ``vectors(id, ord, embedding)``.

    Exact. Up to ``BLOCK`` queries are sent to every task, which keeps the best ``k`` of what it has seen; a window
    merges them. More queries are compared block by block in one plan: each block of queries with each share of
    the vectors in a task. Cosines that agree to nine digits go by ``ord``. Ranks start at 0.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = usable(queries, "embedding", dim).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    held = usable(vectors, "embedding", dim).select("id", "ord", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *held.schema.fields]}
    out = f"query_id {kinds['query_id']}, id {kinds['id']}, ord {kinds['ord']}, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    first = asked.limit(BLOCK + 1).toArrow()  # a bounded look: are they few enough to be sent along?

    def unit(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def keep(ids: list, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best ``k`` rows of each query over the batches ``(id, ord, embedding)``."""
        score, place, row = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.int64)
        names: list = []  # of the rows still held
        step = max(256, 8_000_000 // max(1, len(ids)))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                new = np.round(q @ unit(batch.column(batch.schema.get_field_index("embedding"))).T, 9)
                at = batch.column(batch.schema.get_field_index("ord")).to_numpy(zero_copy_only=False)
                if new.shape[1] > 4 * k:  # whatever ties with the k-th best stays in
                    least = -np.partition(-new, k - 1, axis=1)[:, k - 1]
                    some = np.flatnonzero((new >= least[:, None]).any(0))
                else:
                    some = np.arange(new.shape[1])
                score = np.concatenate((score, new[:, some]), 1)
                place = np.concatenate((place, np.broadcast_to(at[some], (len(ids), len(some)))), 1)
                row = np.concatenate((row, np.broadcast_to(len(names) + np.arange(len(some)), (len(ids), len(some)))), 1)
                names += batch.column(batch.schema.get_field_index("id")).take(pa.array(some)).to_pylist()
                best = np.lexsort((place, -score))[:, :k]
                score, place, row = (np.take_along_axis(x, best, 1) for x in (score, place, row))
                used, row = np.unique(row, return_inverse=True)
                row = row.reshape(score.shape)
                names = [names[i] for i in used.tolist()]
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)]), pa.array([names[i] for i in row.ravel().tolist()]), pa.array(place.ravel()), pa.array(score.ravel())], names=["query_id", "id", "ord", "score"])

    if not first.num_rows:
        return asked.limit(0).join(held.limit(0), F.lit(False)).select("query_id", "id", "ord", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if first.num_rows <= BLOCK:
        block = queries.sparkSession.sparkContext.broadcast((first.column("query_id").to_pylist(), unit(first.column("embedding").combine_chunks())))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in keep(*block.value, batches):
                if found.num_rows:
                    yield found

        best = held.mapInArrow(sent, out)
    else:
        n_blocks = -(-asked.count() // BLOCK)
        n_shares = max(1, -(-held.count() // SHARE))
        left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1))))
        right = held.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(n_shares))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

        def both(_: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
            if not (q.num_rows and x.num_rows):
                return pa.table({"query_id": pa.array([], q.schema.field("query_id").type), "id": pa.array([], x.schema.field("id").type), "ord": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.Table.from_batches(keep(q.column("query_id").to_pylist(), unit(q.column("embedding").combine_chunks()), x.to_batches()))

        best = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(both, out)
    return best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
