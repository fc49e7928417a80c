"""Façade: one store, its ingest, retrieval, browsing and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import is_blank
from lexloom.operators import dense, inventory, lexical, retrieval
from lexloom.plans import check, ingest
from lexloom.session import remove, staged
from lexloom.sources import store
from lexloom.sources.files import json_text  # noqa: F401 - callers print results with it


class Engine:
    """A store in a folder all executors share. ``embedder`` makes vectors (without one, retrieval is by words only);
    ``labels`` is the vocabulary of jurisdictions, code to label."""

    def __init__(self, spark: SparkSession, path: str, embedder: dense.Embedder | None = None, labels: dict[str, str] | None = None):
        self.spark, self.at, self.embedder, self.labels = spark, ingest.Store(path), embedder, labels or {}

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def chunks(self) -> DataFrame:
        """The store's rows, one an id."""
        return store.one_per_id(store.read_store(self.spark, self.at.chunks))

    def _changed(self) -> None:
        remove(self.spark, self.at.index)  # built again by the next retrieval

    def ingest(self, path: str, **about) -> int:
        """Chunks added from one file; see ``plans.ingest.ingest_file``."""
        n = ingest.ingest_file(self.spark, path, self.at, embedder=self.embedder, **about)
        self._changed()
        return n

    def ingest_inventory(self, path: str, **how) -> dict:
        """Counts and rows of a batch; see ``plans.ingest.ingest_inventory``."""
        done = ingest.ingest_inventory(self.spark, path, self.at, embedder=self.embedder, **how)
        if not how.get("dry_run"):
            self._changed()
        return done

    def jurisdictions(self) -> DataFrame:
        return inventory.distinct_jurisdictions(self.chunks())

    def browse(self, region: str, limit: int = inventory.BROWSE_LIMIT) -> DataFrame:
        return inventory.browse(self.chunks(), region, list(self.labels), limit)

    def ready(self) -> bool:
        """Whether there is a chunk to retrieve."""
        return not store.read_store(self.spark, self.at.chunks).isEmpty()

    def index(self) -> lexical.Index:
        """The stored BM25 index, built if the store has changed since."""
        if not self._exists(f"{self.at.index}/terms/_SUCCESS"):  # the table that is written last
            return lexical.build_index(self.chunks(), self.at.index)
        return lexical.read_index(self.spark, self.at.index)

    def retrieve(self, queries: DataFrame, **how) -> DataFrame:
        """Best chunks of ``queries(query_id, text)``; see ``operators.retrieval.hybrid_retrieve``."""
        if self.embedder is not None and self._exists(self.at.vectors):
            asked = dense.embed(queries, self.embedder, ["query_id", "text"]).drop("embedder")
            vectors, dim = store.read_vectors(self.spark, self.at.vectors, self.embedder.name).dropDuplicates(["id"]), self.embedder.dim
        else:
            asked = queries.select("query_id", "text").withColumn("embedding", F.lit(None).cast("array<float>"))
            vectors, dim = self.spark.createDataFrame([], store.VECTOR_SCHEMA), 1
        return retrieval.hybrid_retrieve(asked, self.chunks(), vectors, self.index(), dim=dim, **how)

    def check(self, texts: DataFrame, answers: DataFrame | None = None, *, top_k: int = retrieval.TOP_K, category: str | None = None, jurisdictions: list[str] | None = None, **how) -> DataFrame:
        """Reports of ``texts(report_id, text)``; ``answers(report_id, attempt, raw)`` are a model's, if there is one."""
        if not texts.where(is_blank(F.col("text"))).isEmpty():
            raise ValueError("a text is blank")
        asked = texts.select(F.col("report_id").alias("query_id"), "text")
        hits = staged(self.retrieve(asked, top_k=top_k, category=category, jurisdictions=jurisdictions).select(F.col("query_id").alias("report_id"), "place", "id", "text"), "hits")
        none = self.spark.createDataFrame([], f"report_id {texts.schema['report_id'].dataType.simpleString()}, attempt int, raw string")
        return check.check_reports(texts, hits, none if answers is None else answers, **how)
