"""Files to a chunk store: one by one, by an inventory, with statuses and dates written back."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import chunking, dense, inventory
from lexloom.session import numbered, staged
from lexloom.sources import files, store

META = ("category", "jurisdiction", "document_id", "framework")


@dataclass
class Store:
    """Folders of one store: chunk rows, vectors beside them, and the BM25 index."""

    path: str

    @property
    def chunks(self) -> str:
        return f"{self.path}/chunks"

    @property
    def vectors(self) -> str:
        return f"{self.path}/vectors"

    @property
    def index(self) -> str:
        return f"{self.path}/index"


def chunk_rows(pages: DataFrame, documents: DataFrame, first: int, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Store rows of ``pages(path, page, text)`` of the ``documents(path, position, category, jurisdiction,
    document_id, framework)``. Places continue from document number ``first``, in the order of ``position``."""
    about = documents.select("path", (F.col("position") + first).cast("bigint").alias("doc_no"), *META)
    rows = chunking.file_chunks(pages.select("path", "page", "text").join(about, "path"), size, overlap)
    return rows.select(*(c.split(" ")[0] for c in store.SCHEMA.split(", ")))


def add_chunks(rows: DataFrame, at: Store, embedder: dense.Embedder | None = None, reset: bool = False) -> None:
    """Append store rows, and their vectors if there is an embedder. Chunks go first, so that a store that lost its
    run between the two has chunks without vectors, which retrieval finds by words, and never the reverse."""
    store.write_store(rows, at.chunks, reset)
    if embedder is not None:
        store.write_vectors(dense.embed(rows, embedder, ["id", "ord"]).where("embedding is not null").select("id", "ord", "embedding", "embedder"), at.vectors, reset)


def ingest_file(spark: SparkSession, path: str, at: Store, *, category: str | None = None, jurisdiction: str | None = None, document_id: str | None = None, framework: str | None = None, embedder: dense.Embedder | None = None, reset: bool = False) -> int:
    """Chunks added from one file. A missing file and a PDF without any text are errors; other empty files add none."""
    name = str(Path(path).expanduser().absolute())
    if not Path(name).is_file():
        raise FileNotFoundError(name)
    about = spark.createDataFrame([(name, 0, category, jurisdiction, document_id, framework)], "path string, position int, category string, jurisdiction string, document_id string, framework string")
    rows = staged(chunk_rows(files.document_pages(spark, [name]), about, 0 if reset else store.next_place(spark, at.chunks)), "chunks")
    n = rows.count()
    if not n and name.lower().endswith(".pdf"):
        raise ValueError(f"{name} holds no text; a scanned PDF must be read by OCR first")
    add_chunks(rows, at, embedder, reset)
    return n


def ingest_batch(documents: DataFrame, pages: DataFrame, at: Store | None, *, tier: str | None = None, force: bool = False, reset: bool = False, dry_run: bool = False, embedder: dense.Embedder | None = None) -> DataFrame:
    """``(pos, document_id, tier, ingest_path, status, chunks)`` of every selected row of an inventory.

    ``pages(path, page, text)`` are the pages of the files that exist; a selected document is ``ok`` with its
    chunks (0 is fine), ``missing_file`` if no page has its path, ``error`` if it is a PDF without text, or
    ``dry_run``. Documents are taken in the order of tier and id, all in one plan, and added to the store ``at``.
    A path named by several rows is taken once, for the first of them. A reset empties the store before and takes
    ingested documents again; a batch with nothing to take leaves an empty store then.
    """
    chosen = inventory.select_for_ingest(documents, tier, not force, reset).withColumn("path", F.col("ingest_path"))
    spark = documents.sparkSession
    present = pages.select("path").distinct().withColumn("there", F.lit(True))
    chosen = chosen.withColumn("key", F.coalesce("document_id", F.lit("")))
    chosen = staged(numbered(chosen, ["tier_rank", "key", "pos"], "position").join(present, "path", "left"), "chosen")
    counts = spark.createDataFrame([], "path string, chunks bigint")
    if not dry_run:
        taken = chosen.where("there").groupBy("path").agg(F.min_by(F.struct("position", F.col("document_id").alias("category"), "jurisdiction", "document_id", "framework"), "position").alias("x")).select("path", "x.*")
        first = 0 if reset or at is None else store.next_place(spark, at.chunks)
        rows = staged(chunk_rows(pages, taken, first), "chunks")
        counts = rows.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("chunks"))
        if at is not None:
            add_chunks(rows, at, embedder, reset)
    n = F.coalesce("chunks", F.lit(0).cast("bigint"))
    status = F.when(F.col("there").isNull(), "missing_file").when(F.lit(dry_run), "dry_run").when((n == 0) & F.lower("path").endswith(".pdf"), "error").otherwise("ok")
    return chosen.join(counts, "path", "left").select("pos", "document_id", "tier", "ingest_path", status.alias("status"), n.alias("chunks"))


def ingest_inventory(spark: SparkSession, path: str, at: Store, *, tier: str | None = None, force: bool = False, reset: bool = False, dry_run: bool = False, embedder: dense.Embedder | None = None, now: datetime | None = None) -> dict:
    """Ingest the files of a YAML inventory, write dates back, and return the counts and the rows by status."""
    listed = files.read_inventory(spark, path)
    named = listed.select("pos", "ingest_path").where("ingest_path is not null").toLocalIterator()
    resolved = [(r["pos"], files.resolve_path(r["ingest_path"].strip(), path)) for r in named if r["ingest_path"].strip()]
    there = sorted({p for _, p in resolved if Path(p).is_file()})
    paths = spark.createDataFrame(resolved, "pos bigint, resolved string")
    rows = listed.join(paths, "pos", "left").withColumn("ingest_path", F.col("resolved")).drop("resolved")
    results = staged(ingest_batch(rows, files.document_pages(spark, there), at, tier=tier, force=force, reset=reset, dry_run=dry_run, embedder=embedder), "results")
    stamp = (now or datetime.now(timezone.utc)).replace(microsecond=0).isoformat()
    done = results.where("status = 'ok'").select("pos", F.lit(stamp).alias("stamp"))
    if not dry_run and not done.isEmpty():
        dated = listed.join(done, "pos", "left").withColumn("ingested_at", F.coalesce("stamp", "ingested_at")).drop("stamp")
        files.write_inventory(dated, path, stamp)
    counts = inventory.ingest_summary(results).first().asDict()
    return {"inventory": str(Path(path).absolute()), "store": at.path, "dry_run": dry_run, **counts, "results": [r.asDict() for r in results.drop("pos").orderBy("tier", "document_id").toLocalIterator()]}
