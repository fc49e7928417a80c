"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import WHITE_SPACE
from lexloom.llm import boilerplate, chunk_split, lang_id, mixing, near_dup, quality, tokenise, vector_knn
from lexloom.session import staged, table


FEW = 2_000_000


def _records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``chunks`` with the metadata fields as columns."""
    m = F.col("metadata")
    return table(spark, sf_dir, "chunks").select(*more, "id", "text", "lang", m["source"].alias("source"), m["page"].alias("page"), m["document_id"].alias("document_id"), m["jurisdiction"].alias("jurisdiction"))


def _one_an_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_records`` with one row an id (the last), rows without an id left as they are.

    Only ids and places are shuffled. The places of superseded rows are sent to all tasks where they are few
    (``FEW`` at most); else they are joined, and texts move.
    """
    places = table(spark, sf_dir, "chunks").where("id is not null").select("id", "ord")
    last = places.groupBy("id").agg(F.max("ord").alias("last"), F.count("*").alias("n")).where("n > 1")
    old = staged(places.join(last, "id").where("ord <> last").select("ord"), "superseded")
    old = F.broadcast(old) if old.count() <= FEW else old
    return _records(spark, sf_dir, "ord").join(old, "ord", "left_anti").drop("ord")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records longer than a piece, and whether a piece had to be cut out of an unbroken stretch."""
    pieces = chunk_split.split_records(_records(spark, sf_dir), only_oversized=True)
    return pieces.groupBy("id").agg(F.when(F.max((F.col("cut") == "forced").cast("int")) == 1, "forced").otherwise("natural").alias("cut"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every record, with its place and page."""
    return chunk_split.split_records(_one_an_id(spark, sf_dir))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record with a text: what its pieces cover together, and whether they keep the limits."""
    order = Window.partitionBy("id").orderBy("piece_no")
    p = p1_pieces(spark, sf_dir).withColumn("before", F.lag("end").over(order))
    new = F.expr("substring(text, greatest(coalesce(before, 0) - start, 0) + 1)")
    bare = F.regexp_replace(new, f"[{WHITE_SPACE}]+", "")
    good = (F.length("text") == F.col("end") - F.col("start")) & (F.length("text") <= 900) & (F.coalesce(F.col("before"), F.lit(0)) - F.col("start") <= 150)
    each = p.groupBy("id", "page").agg(F.sort_array(F.collect_list(F.struct("piece_no", bare.alias("t")))).alias("x"), F.min("start").alias("first"), F.max("end").alias("n_chars"), F.min(good.cast("int")).alias("good"), F.count("*").alias("n"), F.max("n_pieces").alias("of"))
    return each.select("id", F.col("page").cast("bigint").alias("page"), F.col("n_chars").cast("bigint").alias("n_chars"), F.md5(F.array_join(F.transform("x", lambda v: v["t"]), "")).alias("text_md5"), ((F.col("good") == 1) & (F.col("first") == 0) & (F.col("n") == F.col("of"))).alias("kept"))


def _clauses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_dup.similar_classes(_records(spark, sf_dir), threshold=0.5, width=3, min_words=40)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records at least half of whose word triples are common to both."""
    return near_dup.similar_pairs(*_clauses(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of similar texts of every record of 40 words or more."""
    return near_dup.groups(*_clauses(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line repeated within its source."""
    return boilerplate.find_blocks(_records(spark, sf_dir))[1].select("id", "line_no")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text without the lines repeated within its source."""
    rows = _one_an_id(spark, sf_dir)
    return boilerplate.remove_blocks(rows, boilerplate.find_blocks(rows)[0])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every record whose label isn't right."""
    rows = _records(spark, sf_dir)
    held = lang_id.detect(rows, lang_id.fit(rows))
    wrong = held.where("size(langs) > 1 or (size(langs) = 1 and not (label <=> langs[0]))")
    return wrong.select("id", F.explode("langs").alias("lang")).distinct()


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines of one language in every record, with a confidence."""
    rows = _records(spark, sf_dir)
    held = lang_id.detect(rows, lang_id.fit(rows)).select("id", F.posexplode("segments").alias("segment", "s"))
    return held.select("id", "segment", "s.first_line", "s.last_line", "s.lang", F.round("s.confidence", 2).alias("confidence")).dropDuplicates(["id", "segment"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at cosine 0.90 or more, one among the 5 most similar others of the other."""
    near = vector_knn.similar_vectors(table(spark, sf_dir, "chunk_vectors"), k=5, least=0.9).where("cosine >= 0.9")
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar others of every usable vector, with their cosine."""
    near = vector_knn.similar_vectors(table(spark, sf_dir, "chunk_vectors"), k=5)
    return near.select("id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar others of every twentieth id (by its hash), searched among all vectors."""
    vectors = table(spark, sf_dir, "chunk_vectors")
    asked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(20)) == 0).select(F.col("id").alias("query_id"), "embedding")
    return vector_knn.search_vectors(vectors, asked).select("query_id", "neighbour", F.round("cosine", 5).alias("cosine"), "rank")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by ``byte_bpe_50k``."""
    return tokenise.encode_corpus(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture of sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of every source of the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents more than half of which is a list, a table or junk."""
    return quality.text_statistics(table(spark, sf_dir, "documents")).where("kind is not null").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text figures of every document."""
    return quality.text_statistics(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts among those figures that don't depend on the kinds of lines."""
    return p8_statistics(spark, sf_dir).select("doc_id", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_ended", "n_common")


QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p8_counts": p8_counts, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_segments": p4_segments, "p5_found": p5_found, "p5_knn": p5_knn, "p5_search": p5_search, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics}
