"""BM25 over a chunk store, for batches of queries, from a stored index.

The index is three Parquet tables beside each other: ``postings`` (term, ord, tf, dl), in folders by a hash of the
term and sorted by term; ``terms`` (term, df, raw_idf, idf); ``docs`` (id, ord, pos), ``pos`` counting the chunks
in store order from 0; and one row of ``stats`` (n, avgdl). A batch of queries reads the postings of its own terms:
no text is scanned and no vocabulary is sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import is_blank, tokens
from lexloom.session import numbered, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
POOL = 24
#: Folders of the postings.
BUCKETS = 16


@dataclass
class Index:
    """A stored index, as DataFrames."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(store: DataFrame) -> DataFrame:
    """``(bucket, term, ord, tf, dl)``: each batch counts its own chunks, so nothing is shuffled for that."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                lists = batch.column(1)
                dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                cell, tf = np.unique(np.repeat(np.arange(batch.num_rows), dl) * size + coded.indices.to_numpy(), return_counts=True)
                row = cell // size
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(cell % size)), batch.column(0).take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(dl[row].astype(np.int32))], names=["term", "ord", "tf", "dl"])

    return store.select("ord", tokens(F.col("text")).alias("toks")).mapInArrow(count, "term string, ord bigint, tf int, dl int")


def build_index(store: DataFrame, path: str) -> Index:
    """Write the index of a store (one row an id) to a folder all executors share; replaces what was there."""
    spark = store.sparkSession
    rows = _postings(store).withColumn("bucket", _bucket("term"))
    rows.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(1 << 20)) % 64).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs = numbered(store.select("id", "ord"), ["ord"])
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    held = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    n = spark.read.schema("id string, ord bigint, pos bigint").parquet(f"{path}/docs").agg(F.count("*").alias("n"))
    stats = n.crossJoin(held.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))).select("n", F.try_divide("total", "n").alias("avgdl"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.schema("n bigint, avgdl double").parquet(f"{path}/stats")
    counted = held.groupBy("term").agg(F.count("*").alias("df"))
    raw = counted.crossJoin(F.broadcast(stats)).withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).select("term", "df", "raw_idf")
    raw = staged(raw, "terms")
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    idf = F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    raw.crossJoin(F.broadcast(mean)).select("term", "df", "raw_idf", idf.alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(spark, path)


POSTINGS = "term string, ord bigint, tf int, dl int, bucket int"


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index; an index of an empty store has no postings."""
    return Index(
        spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema("term string, df bigint, raw_idf double, idf double").parquet(f"{path}/terms"),
        spark.read.schema("id string, ord bigint, pos bigint").parquet(f"{path}/docs"), spark.read.schema("n bigint, avgdl double").parquet(f"{path}/stats"),
    )


def bm25_topk(queries: DataFrame, index: Index, k: int = POOL) -> DataFrame:
    """``(query_id, id, ord, score, rank)``, ranks from 0, the best ``k`` chunks of every non-blank query.

    There is no threshold: chunks without a common token score 0 and rank by ``ord`` below positive and above
    negative scores. Scores that agree to nine digits are ties and go by ``ord``. A query's tokens count as often
    as it holds them; a null, empty or blank query has no rows, an empty store gives none.

    Terms of all queries join the postings once, whatever their number; only query terms move, unless they are
    many. A query with fewer than ``k`` positive scores is filled up: what it needs lies within the first k + m
    places, m being its matches, so no query is crossed with all chunks.
    """
    if k < 1:
        raise ValueError("k must be positive")
    live = queries.where(~is_blank(F.col("text"))).select("query_id", "text")
    asked = live.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighed = index.terms.select("term", "idf").join(asked, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), _bucket("term").alias("bucket"))
    met = index.postings.join(weighed, ["bucket", "term"]).crossJoin(F.broadcast(index.stats.select("avgdl")))
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = staged(met.groupBy("query_id", "ord").agg(F.round(F.sum(gain), 9).alias("score")), "scores")  # read three times below
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    matched = scored.groupBy("query_id").agg(F.count("*").alias("m"), F.count_if(F.col("score") > 0).alias("n_positive"))
    short = live.select("query_id").distinct().join(matched, "query_id", "left").where(F.coalesce("n_positive", F.lit(0)) < k)
    places = short.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("m", F.lit(0)) + k - 1)).alias("pos"))
    filled = places.join(index.docs.select("ord", "pos"), "pos").join(scored.select("query_id", "ord"), ["query_id", "ord"], "left_anti").select("query_id", "ord", F.lit(0.0).alias("score"))
    best = scored.union(filled).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return best.join(index.docs.select("id", "ord"), "ord").select("query_id", "id", "ord", "score", "rank")
