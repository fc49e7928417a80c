"""Texts and a model's raw answers to audited reports, for all reports at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import classify, grounding
from lexloom.session import staged

MAX_ATTEMPTS = 2
NOTE_UNGROUNDED = "No attempt passed the check of its citations."
NOTE_NO_OVERLAP = "No attempt kept a recommendation that shares enough words with its chunks."
RECOMMENDATION = "struct<text: string, evidence_chunk_ids: array<string>, overlap_score: double>"


def check_reports(
    texts: DataFrame, hits: DataFrame, answers: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, grounding_strict: bool = True, min_overlap: float = grounding.MIN_OVERLAP, flag_unparsed: bool = True
) -> DataFrame:
    """The final report of every row of ``texts(report_id, text[, error])``.

    ``hits(report_id, place, id, text)`` are its retrieved chunks, ``answers(report_id, attempt, raw)`` what a model
    said, attempts counted from 1. An attempt is salvaged, coerced and audited against the report's own chunks;
    if that passes, recommendations of too little token overlap go, and an attempt of which none is left has
    failed. The first attempt that passes is the report, else the last one allowed, with its issues. Attempts
    are rows, so there is no loop and nothing is collected.

    A text without hits gets the empty-store report; one with an ``error`` or without an answer the keyword
    report, audited too. With ``flag_unparsed`` recommendations that were there but can't be read are an issue; else such
    an attempt passes as one without recommendations. Repeated attempts of one number count in no stated order.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    none = F.array().cast("array<string>")
    error = F.col("error") if "error" in texts.columns else F.lit(None).cast("string")
    base = texts.select("report_id", "text", error.alias("error"))
    allowed = hits.select("report_id", "id").distinct()
    found = hits.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("x")).select("report_id", F.transform("x", lambda v: v["id"]).alias("ids"))
    asked = base.where("error is null").join(found.select("report_id"), "report_id", "left_semi")
    tried = answers.where(F.col("attempt").between(1, max_attempts)).dropDuplicates(["report_id", "attempt"]).join(asked, "report_id")
    key = F.struct("report_id", "attempt")
    read = staged(tried.select(key.alias("report_id"), grounding.coerce_report(F.col("raw"), classify.study_type(F.col("text"))).alias("r")).select("report_id", "r.*"), "answers")

    recs = read.select("report_id", F.posexplode("recommendations").alias("rec_no", "r")).select("report_id", "rec_no", "r.text", "r.evidence_chunk_ids")
    cited = read.select("report_id", F.posexplode("citations").alias("citation_no", "c")).select("report_id", "citation_no", "c.is_object", "c.chunk_id")
    own = read.select(F.col("report_id.report_id").alias("of"), "report_id").join(allowed.withColumnRenamed("report_id", "of"), "of").select("report_id", "id")
    audited = grounding.audit(recs, own, cited, require_evidence=grounding_strict, reports=read.select("report_id", (F.col("unparsed") & flag_unparsed).alias("unparsed")))
    chunks = hits.groupBy("id").agg(F.first("text").alias("text"))
    stats = grounding.overlap_stats(grounding.overlap_filter(grounding.token_recall(recs, chunks), min_overlap), min_overlap, reports=read)

    lost = F.col("ok") & F.col("dropped_all") & F.lit(min_overlap > 0)
    raised = F.when(lost, F.array(F.lit(f"Every recommendation shares less than {min_overlap} of its words with the chunks it cites."))).otherwise(none)
    kept = F.transform("kept", lambda x: F.struct(x["text"], x["evidence_chunk_ids"], x["overlap_score"]))
    raw = F.transform("recommendations", lambda x: F.struct(x["text"], x["evidence_chunk_ids"], F.lit(None).cast("double").alias("overlap_score")))
    more = F.when(lost, NOTE_NO_OVERLAP).when(~F.col("ok"), NOTE_UNGROUNDED)
    judged = read.join(audited, "report_id").join(stats, "report_id").select(
        F.col("report_id.report_id").alias("report_id"), F.col("report_id.attempt").alias("attempt"), "study_type", "status", "missing_elements",
        F.when(F.col("ok"), kept.cast(f"array<{RECOMMENDATION}>")).otherwise(raw.cast(f"array<{RECOMMENDATION}>")).alias("recommendations"),
        F.transform(F.filter("citations", lambda c: c["is_object"]), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["reason"].alias("reason"))).alias("citations"),
        F.nullif(F.concat_ws(" ", "notes", more), F.lit("")).alias("notes"), (F.col("ok") & ~lost).alias("ok"), F.concat("issues", raised).alias("issues"),
        "allowed_chunk_count", F.when(F.col("ok"), F.col("kept_count")).otherwise(F.col("recommendation_count")).alias("recommendation_count"), "invalid_evidence_chunk_ids",
        F.when(F.col("ok"), F.col("dropped_count")).otherwise(0).alias("dropped_count"), lost.alias("dropped_all"), F.col("unparsed").alias("parse_warning"), "parse_failed",
    )
    final = grounding.final_attempt(judged, max_attempts).withColumnsRenamed({"attempt": "grounding_attempts", "ok": "grounding_ok"}).withColumn("made_by", F.lit("model"))

    plain = base.join(read.select("report_id.report_id").distinct(), "report_id", "left_anti")
    simple = classify.fallback_report(plain, found, grounding_strict)
    same = lambda c, kind: F.lit(None).cast(kind).alias(c)
    simple = simple.select(
        "report_id", "study_type", "status", "missing_elements", F.transform("recommendations", lambda x: F.struct(x["text"], x["evidence_chunk_ids"], F.lit(None).cast("double").alias("overlap_score"))).cast(f"array<{RECOMMENDATION}>").alias("recommendations"),
        "citations", "notes", "grounding_ok", "issues", "allowed_chunk_count", F.col("recommendation_count").cast("bigint").alias("recommendation_count"), none.alias("invalid_evidence_chunk_ids"),
        same("dropped_count", "bigint"), F.lit(False).alias("dropped_all"), F.lit(False).alias("parse_warning"), F.lit(False).alias("parse_failed"), F.when(F.col("overlap_skipped"), "keywords").otherwise("empty store").alias("made_by"), "grounding_attempts",
    )
    return final.select(*simple.columns).unionByName(simple)
