"""Incremental ingest: a stream of documents into a chunk store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.chunking import OVERLAP, SIZE, file_chunks
from lexloom.session import exists, numbered, remove
from lexloom.sources import store

#: A document number has this many bits beside those of the chunk in a place (``ord``), and a sign.
NUMBER_BITS = 31


def document_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Documents of files as they appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def start_ingest(documents: DataFrame, at: str, checkpoint: str, once: bool = True, size: int = SIZE, overlap: int = OVERLAP) -> StreamingQuery:
    """Append the chunks of arriving ``documents(path, page, text, category, jurisdiction, document_id, framework,
    doc_no)`` to a chunk store, in its own schema. A file arrives whole, with a number of its own (``doc_no``), which gives
    its chunks their places. Each batch's rows go to a folder named by the stream and the batch, written anew if the batch
    is run again, so a batch that failed half-way leaves nothing twice.

    Numbers that don't fit in a place (31 bits) only order the documents: a batch that has any takes the next numbers of the
    store for all its documents, and so does every later batch, as the callers' numbers may be taken then."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark, folder, counted = batch.sparkSession, f"{at}/stream-{stream}-{number:09}", f"{at}/counted"
        least, most = batch.agg(F.min("doc_no"), F.max("doc_no")).first()
        if exists(spark, counted) or (least is not None and not -(1 << NUMBER_BITS) <= least <= most < 1 << NUMBER_BITS):
            before, folder = folder, f"{counted}/stream-{stream}-{number:09}"
            for old in (before, folder):  # if the batch is run again, its documents get the same numbers
                remove(spark, old)
            files = numbered(batch.where("doc_no is not null").groupBy("path").agg(F.min("doc_no").alias("doc_no")), ["doc_no", "path"], "place")
            places = files.select("path", (F.col("place") + store.next_place(spark, at)).alias("doc_no"))
            batch = batch.drop("doc_no").join(places, "path", "left")
        rows = file_chunks(batch, size, overlap).select(*(c.split(" ")[0] for c in store.SCHEMA.split(", ")))
        store.write_store(rows, folder, reset=True)

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
