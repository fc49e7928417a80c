"""The chunk store: reading, writing, repeated ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import exists

SCHEMA = "id string, ord bigint, text string, source string, source_path string, page bigint, category string, jurisdictions array<string>, document_id string, framework string"
#: Vectors carry their chunk's place, so retrieval needs no join for it. Vectors of one store come from one embedder.
VECTOR_SCHEMA = "id string, ord bigint, embedding array<float>, embedder string"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a store, also of the folders that streams add; an absent store is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def _fitting(rows: DataFrame, schema: str, what: str) -> DataFrame:
    """``rows`` with exactly the columns of the schema; refuses rows that lack one or have it in another type."""
    wanted = [c.split(" ", 1) for c in schema.split(", ")]
    have = dict(rows.dtypes)
    wrong = [f"{name} {kind} (not {have.get(name, 'there')})" for name, kind in wanted if have.get(name) != kind]
    if wrong:
        raise ValueError(f"these are no {what} rows; wanted: " + ", ".join(wrong))
    return rows.select(*(name for name, _ in wanted))


def write_store(chunks: DataFrame, path: str, reset: bool = False) -> None:
    """Append chunk rows to a store, or replace it. Rows that aren't of ``SCHEMA`` are refused."""
    _fitting(chunks, SCHEMA, "chunk").write.mode("overwrite" if reset else "append").parquet(path)


def write_vectors(vectors: DataFrame, path: str, reset: bool = False) -> None:
    """Append vectors to a store, or replace them; one row an id, refused unless of ``VECTOR_SCHEMA``."""
    _fitting(vectors, VECTOR_SCHEMA, "vector").dropDuplicates(["id"]).write.mode("overwrite" if reset else "append").parquet(path)


def next_place(spark: SparkSession, path: str) -> int:
    """First document number after those of a store: places are ``number * 2^32 + chunk``."""
    last = read_store(spark, path).agg(F.max("ord")).first()[0]
    return 0 if last is None else (last >> 32) + 1


def read_vectors(spark: SparkSession, path: str, embedder: str) -> DataFrame:
    """Vectors of a store; fails if any was made by another embedder."""
    rows = spark.read.schema(VECTOR_SCHEMA).parquet(path)
    other = rows.where(F.coalesce("embedder", F.lit("")) != embedder).select("embedder").limit(1).collect()
    if other:
        raise ValueError(f"vectors were made by {other[0][0]!r}, not {embedder!r}")
    return rows


def one_per_id(chunks: DataFrame) -> DataFrame:
    """One row per id: the content of the last, the place (``ord``, unique) of the first.

    Only ids and places are shuffled. What is joined to the rows is the table of repeated ids' places, which
    is small unless much was ingested again; texts stay where they are, and unused columns are never read.
    """
    places = chunks.select("id", "ord")
    repeated = places.groupBy("id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    affected = places.join(repeated, "id").select(F.col("ord").alias("__ord"), F.when(F.col("ord") == F.col("last"), F.col("first")).alias("__place"))
    joined = chunks.join(affected, chunks["ord"] == affected["__ord"], "left").where("__ord is null or __place is not null")
    return joined.select(*(F.coalesce("__place", "ord").alias("ord") if c == "ord" else F.col(c) for c in chunks.columns))


def from_manifest(chunks: DataFrame) -> DataFrame:
    """Store rows from ``(ord, id, text, metadata)``; the scalar jurisdiction becomes a list of one."""
    m = F.col("metadata")
    tags = F.when(m["jurisdiction"].isNotNull(), F.array(m["jurisdiction"]))
    return one_per_id(chunks.select("id", "ord", "text", *(m[c].alias(c) for c in ("source", "source_path")), m["page"].cast("bigint").alias("page"), *(m[c].alias(c) for c in ("category", "document_id", "framework")), tags.alias("jurisdictions")))
