"""Normalisation and audits of reports: allow-lists, token recall, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip, tokens

MIN_OVERLAP = 0.06
DROPPED_LISTED = 20
REC = "array<struct<text: string, evidence_chunk_ids: array<string>>>"


def salvage(raw: Column) -> Column:
    """A model's answer as a VARIANT object: the text itself, else what stands between its first and last
    brace, else an empty object."""
    obj = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(obj(F.try_parse_json(raw)), obj(F.try_parse_json(F.regexp_extract(raw, r"\{[\s\S]*\}", 0))), F.parse_json(F.lit("{}")))


def parse_failed(raw: Column) -> Column:
    """Whether nothing could be salvaged from a non-empty answer."""
    return (F.coalesce(raw, F.lit("")) != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT") | F.schema_of_variant(F.try_parse_json(F.regexp_extract(raw, r"\{[\s\S]*\}", 0))).startswith("OBJECT"), F.lit(False))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _truthy(v: Column, name: str) -> Column:
    """Field as text unless it is absent, null, empty, zero, false or an empty container."""
    text = _field(v, name)
    return F.when(~text.isin("", "0", "0.0", "false", "[]", "{}"), text)


def _ids(v: Column, name: str) -> Column:
    """A list field as strings; any other value that counts as true is an empty list, else null."""
    found = F.try_variant_get(v, f"$.{name}", "array<string>")
    return F.when(F.size(found) > 0, found).when(found.isNull() & _truthy(v, name).isNotNull(), F.array().cast("array<string>"))


def normalise_items(recs: Column) -> Column:
    """A VARIANT list of recommendations as ``array<struct<text, evidence_chunk_ids>>``.

    Texts become items without evidence; objects take ``text`` or else ``recommendation``, and
    ``evidence_chunk_ids`` or else ``chunk_ids``; other items vanish; anything but a list is empty.
    """
    items = F.try_variant_get(recs, "$", "array<variant>")

    def item(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        none = F.array().cast("array<string>")
        plain = F.struct(strip(F.try_variant_get(v, "$", "string")).alias("text"), none.alias("evidence_chunk_ids"))
        full = F.struct(strip(F.coalesce(_truthy(v, "text"), _truthy(v, "recommendation"), F.lit(""))).alias("text"), F.coalesce(_ids(v, "evidence_chunk_ids"), _ids(v, "chunk_ids"), none).alias("evidence_chunk_ids"))
        return F.when(kind == "STRING", plain).when(kind.startswith("OBJECT"), full)

    return F.coalesce(F.filter(F.transform(items, item), lambda x: x.isNotNull()), F.array().cast(REC))


def citations(v: Column) -> Column:
    """A report's citations as ``array<struct<is_object, chunk_id, reason>>``; anything but a list is empty."""
    items = F.try_variant_get(v, "$.citations", "array<variant>")
    one = lambda c: F.struct(F.schema_of_variant(c).startswith("OBJECT").alias("is_object"), _field(c, "chunk_id").alias("chunk_id"), _field(c, "reason").alias("reason"))
    return F.coalesce(F.transform(items, one), F.array().cast("array<struct<is_object: boolean, chunk_id: string, reason: string>>"))


def coerce_report(raw: Column, guess: Column) -> Column:
    """Struct of a report's fields with their defaults, from a model's answer.

    Values of another type come out as JSON spells them (``true``, ``1.5``); a null counts as absent.
    ``unparsed`` marks recommendations that were there, but no list with an item to be used.
    """
    v = salvage(raw)
    listed = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(_field(v, "study_type"), guess).alias("study_type"), F.coalesce(_field(v, "status"), F.lit("Unknown")).alias("status"),
        listed("missing_elements").alias("missing_elements"), normalise_items(F.try_variant_get(v, "$.recommendations", "variant")).alias("recommendations"),
        _truthy(v, "notes").alias("notes"), parse_failed(raw).alias("parse_failed"),
        (_truthy(v, "recommendations").isNotNull() & (F.size(normalise_items(F.try_variant_get(v, "$.recommendations", "variant"))) == 0)).alias("unparsed"),
        citations(v).alias("citations"),
    )


def recall(rec_tokens: Column, chunk_tokens: Column) -> Column:
    """Share of the first array's distinct tokens that the second holds; 0 if there are none."""
    own = F.array_distinct(rec_tokens)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, chunk_tokens)) / F.size(own)).otherwise(0.0)


def token_recall(recs: DataFrame, store: DataFrame) -> DataFrame:
    """``(report_id, rec_no, text, evidence_chunk_ids, score)``: the best recall over the cited chunks.

    Ids without a chunk and chunks without text are passed over; a recommendation without any scores 0.
    """
    base = recs.select("report_id", "rec_no", strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")).alias("evidence_chunk_ids"))
    cited = base.select("report_id", "rec_no", tokens(F.col("text")).alias("rt"), F.explode(F.array_distinct("evidence_chunk_ids")).alias("id"))
    best = cited.join(store.select("id", F.col("text").alias("chunk_text")), "id").groupBy("report_id", "rec_no").agg(F.max(recall(F.col("rt"), tokens(F.col("chunk_text")))).alias("score"))
    return base.join(best, ["report_id", "rec_no"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def overlap_filter(scored: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """``scored`` with ``kept`` and ``reason``: no ids drop first, then a recall below the threshold; a
    threshold of 0 or less keeps whatever has ids."""
    reason = F.when(F.size("evidence_chunk_ids") == 0, "no_evidence_chunk_ids")
    if min_overlap > 0:
        reason = reason.when(F.col("score") < min_overlap, "low_token_overlap")
    return scored.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).withColumn("score", F.when(F.col("reason") == "no_evidence_chunk_ids", 0.0).otherwise(F.col("score")))


def overlap_stats(filtered: DataFrame, min_overlap: float = MIN_OVERLAP, reports: DataFrame | None = None) -> DataFrame:
    """Counts per report, whether nothing is left of what there was, the kept items with their scores to four
    digits, and the first dropped items with their raw scores. ``reports(report_id)`` adds reports without items."""
    dropped = F.when(~F.col("kept"), F.struct("rec_no", "reason", F.substring("text", 1, 120).alias("text_preview"), "score"))
    kept = F.when(F.col("kept"), F.struct("rec_no", "text", "evidence_chunk_ids", F.round("score", 4).alias("overlap_score")))
    order = Window.partitionBy("report_id").orderBy("rec_no")
    lost = filtered.withColumn("nth", F.sum((~F.col("kept")).cast("int")).over(order))
    out = lost.groupBy("report_id").agg(
        F.count("*").alias("input_count"), F.count_if("kept").alias("kept_count"), F.count_if(~F.col("kept")).alias("dropped_count"), (F.count_if("kept") == 0).alias("dropped_all"),
        F.lit(min_overlap).alias("min_threshold"), F.sort_array(F.collect_list(F.when(F.col("nth") <= DROPPED_LISTED, dropped))).alias("dropped"), F.sort_array(F.collect_list(kept)).alias("kept"),
    )
    if reports is None:
        return out
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input_count", "kept_count", "dropped_count")} | {"dropped_all": F.coalesce("dropped_all", F.lit(False)), "min_threshold": F.lit(min_overlap)}
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("dropped", "kept")}
    return reports.select("report_id").distinct().join(out, "report_id", "left").withColumns(zero | empty)


def _quoted(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


UNPARSED = "Field 'recommendations' was present but could not be parsed."


def audit(recs: DataFrame, allowed: DataFrame, citations: DataFrame | None = None, *, require_evidence: bool = True, reports: DataFrame | None = None) -> DataFrame:
    """Audit of every report: ``(report_id, ok, issues, allowed_chunk_count, recommendation_count, invalid_evidence_chunk_ids)``.

    ``recs(report_id, rec_no, text, evidence_chunk_ids)``; ``allowed(report_id, id)``, or ``allowed(id)``
    for one allow-list of all reports; ``citations(report_id, citation_no, is_object, chunk_id)`` adds the
    issues, counts and valid ids of supplementary citations; ``reports(report_id[, unparsed])`` names reports that may
    have no recommendation at all (ok, with count 0) and those whose recommendations were there but not to be
    parsed. Issues: unparsed first, then by recommendation, then invalid ids, then citations. Membership is an
    anti join; nothing is collected.
    """
    order = Window.partitionBy("report_id").orderBy("rec_no")
    at = recs.withColumn("i", F.row_number().over(order) - 1).select("report_id", "i", strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")).alias("ids"))
    name = F.concat(F.lit("recommendations["), F.col("i"), F.lit("]"))
    flaws = [F.when(F.col("text") == "", F.struct(F.lit(0).alias("part"), "i", F.lit(0).alias("k"), F.concat(name, F.lit(" has empty text.")).alias("issue")))]
    if require_evidence:
        flaws.append(F.when(F.size("ids") == 0, F.struct(F.lit(0).alias("part"), "i", F.lit(1).alias("k"), F.concat(name, F.lit(" has empty evidence_chunk_ids.")).alias("issue"))))
    own = at.select("report_id", F.explode(F.filter(F.array(*flaws), lambda x: x.isNotNull())).alias("x")).select("report_id", "x.*")
    keys = ["report_id", "id"] if "report_id" in allowed.columns else ["id"]
    cited = at.select("report_id", "i", F.posexplode("ids").alias("pos", "id"))
    bad = cited.join(allowed.select(*keys).distinct(), keys, "left_anti")
    first = bad.groupBy("report_id", "id").agg(F.min(F.struct("i", "pos")).alias("at"))
    invalid = first.groupBy("report_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("invalid"))
    listed = invalid.select("report_id", F.lit(1).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("k"), F.concat(F.lit("Invalid evidence_chunk_ids (not in retrieved set): "), _quoted(F.col("invalid"))).alias("issue"))
    issues = own.unionByName(listed)
    counts = at.groupBy("report_id").agg(F.count("*").alias("recommendation_count"))
    if citations is not None:
        ok = citations.join(allowed.select(*keys).distinct().withColumnRenamed("id", "chunk_id").withColumn("known", F.lit(True)), [k if k != "id" else "chunk_id" for k in keys], "left")
        where = F.concat(F.lit("citations["), F.col("citation_no"), F.lit("]"))
        flaw = F.when(~F.col("is_object"), F.concat(where, F.lit(" is not an object."))).when(F.col("chunk_id").isNotNull() & F.col("known").isNull(), F.concat(where, F.lit(" invalid chunk_id: '"), F.col("chunk_id"), F.lit("'")))
        issues = issues.unionByName(ok.select("report_id", F.lit(2).alias("part"), F.col("citation_no").alias("i"), F.lit(0).alias("k"), flaw.alias("issue")).where("issue is not null"))
        valid = ok.groupBy("report_id").agg(F.count("*").alias("citation_count"), F.transform(F.sort_array(F.collect_list(F.when(F.col("is_object") & F.col("known"), F.struct("citation_no", "chunk_id")))), lambda x: x["chunk_id"]).alias("valid_citation_chunk_ids"))
        counts = counts.join(valid, "report_id", "full_outer").withColumn("recommendation_count", F.coalesce("recommendation_count", F.lit(0)))
    if reports is not None:
        counts = reports.select("report_id").distinct().join(counts, "report_id", "left").withColumn("recommendation_count", F.coalesce("recommendation_count", F.lit(0)))
        if "unparsed" in reports.columns:
            issues = issues.unionByName(reports.where("unparsed").select("report_id", F.lit(-1).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(UNPARSED).alias("issue")))
    listed_issues = issues.groupBy("report_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "i", "k", "issue"))), lambda x: x["issue"]).alias("issues"))
    none = F.array().cast("array<string>")
    out = counts.join(listed_issues, "report_id", "left").join(invalid, "report_id", "left")
    if "report_id" in keys:
        out = out.join(allowed.groupBy("report_id").agg(F.countDistinct("id").alias("allowed_chunk_count")), "report_id", "left").withColumn("allowed_chunk_count", F.coalesce("allowed_chunk_count", F.lit(0)))
    else:
        out = out.crossJoin(F.broadcast(allowed.agg(F.countDistinct("id").alias("allowed_chunk_count"))))
    rest = [c for c in counts.columns if c not in ("report_id", "recommendation_count")]
    return out.select("report_id", F.col("issues").isNull().alias("ok"), F.coalesce("issues", none).alias("issues"), "allowed_chunk_count", "recommendation_count", F.coalesce("invalid", none).alias("invalid_evidence_chunk_ids"), *rest)


def final_attempt(attempts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Of ``attempts(report_id, attempt, ok, ...)`` (from 1) the first that is ok, else the last allowed one."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    tried = attempts.where(F.col("attempt") <= max_attempts)
    order = Window.partitionBy("report_id").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    return tried.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def review_flag(n_hits: Column, ok: Column, min_recall: Column, weak: int = 3, low: float = 0.15) -> Column:
    """Why a person should look at a report: weak retrieval, failed grounding, low overlap, or null."""
    return F.when(n_hits < weak, "weak_retrieval").when(~ok, "grounding_failed").when(min_recall < low, "low_overlap")
