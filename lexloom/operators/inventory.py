"""The corpus inventory: filters, tiers, ingest selection and results; browsing of the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import blank_to_null, codes, is_blank, strip

# Tiers in order; the code of rules that hold everywhere.
TIERS = ["P0", "P1", "P2"]
OTHER_TIER = 9
EVERYWHERE = "INTL"
BROWSE_LIMIT, BROWSE_MOST = 25, 80
BROWSED = ["id", "text", "source", "source_path", "page", "category", "jurisdictions", "document_id", "framework"]


def option_label(code: Column, labels: dict[str, str]) -> Column:
    """``code — label`` of a code of the caller's vocabulary, else the normalised code itself."""
    c = F.upper(strip(code))
    if not labels:
        return c
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.concat(c, F.coalesce(F.concat(F.lit(" — "), F.element_at(known, c)), F.lit("")))


def codes_of_labels(chosen: Column, labels: dict[str, str]) -> Column:
    """Codes of an array of displayed labels, in order; what is no label of the vocabulary stands for itself."""
    shown = {f"{k} — {v}": k for k, v in labels.items()}
    if not shown:
        return codes(chosen)
    known = F.create_map(*(F.lit(x) for pair in shown.items() for x in pair))
    return codes(F.transform(chosen, lambda x: F.coalesce(F.element_at(known, x), x)))


def primary_jurisdiction(values: Column, everywhere: str = EVERYWHERE) -> Column:
    """First code that isn't the one for everywhere, else the first code, else null."""
    all_codes = codes(values)
    return F.coalesce(F.get(F.filter(all_codes, lambda c: c != everywhere), F.lit(0)), F.get(all_codes, F.lit(0)))


def tier_rank(tier: Column) -> Column:
    t = F.upper(tier)
    return F.coalesce(*(F.when(t == name, F.lit(i)) for i, name in enumerate(TIERS)), F.lit(OTHER_TIER))


def listing(inventory: DataFrame, region: str | None = None) -> DataFrame:
    """Display columns of the documents of a region (all for None or ALL; none for an unknown one)."""
    rows = inventory
    if region and region.upper() != "ALL":
        rows = rows.where(F.coalesce(F.array_contains(F.transform("jurisdiction", F.upper), region.upper()), F.lit(False)))
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        "pos", F.coalesce("document_id", F.lit("")).alias("document_id"), F.coalesce(text("title"), text("document_id"), F.lit("Untitled")).alias("title"),
        F.coalesce(text("tier"), F.lit("P2")).alias("tier"), F.array_join(F.coalesce("jurisdiction", F.array().cast("array<string>")), "|").alias("jurisdiction"),
        text("ingested_at").alias("ingested_at"), strip(blank_to_null(F.col("source_url"))).alias("source_url"),
    )


def by_tier(inventory: DataFrame) -> DataFrame:
    """Documents of the named tiers in tier order, then inventory order; a blank tier counts as P2."""
    tier = F.upper(F.coalesce(F.when(F.col("tier") != "", F.col("tier")), F.lit("P2")))
    return inventory.withColumn("shown_tier", tier).where(F.col("shown_tier").isin(TIERS)).select("shown_tier", "pos", "document_id")


def select_for_ingest(inventory: DataFrame, tier: str | None = None, skip_ingested: bool = True, reset: bool = False) -> DataFrame:
    """Documents to ingest with their sort key (tier rank, document id). A reset store takes ingested ones again."""
    rows = inventory.where(~is_blank(F.col("ingest_path")))
    if tier:
        rows = rows.where(F.upper(F.coalesce("tier", F.lit(""))) == tier.upper())
    if skip_ingested and not reset:
        rows = rows.where(F.coalesce("ingested_at", F.lit("")) == "")
    return rows.select("pos", "document_id", "tier", tier_rank(F.col("tier")).alias("tier_rank"), primary_jurisdiction(F.col("jurisdiction")).alias("jurisdiction"), strip(blank_to_null(F.col("framework"))).alias("framework"), "ingest_path")


def ingest_results(selected: DataFrame, chunk_counts: DataFrame, present: DataFrame, dry_run: bool = False) -> DataFrame:
    """``selected`` with ``status`` and ``chunks``: files not in ``present(path)`` are missing, the others
    are ok with the chunks of ``chunk_counts(path, chunks)`` (0 is ok), or only listed in a dry run."""
    seen = selected.join(present.select(F.col("path").alias("ingest_path"), F.lit(True).alias("found")).distinct(), "ingest_path", "left").join(chunk_counts.select(F.col("path").alias("ingest_path"), "chunks"), "ingest_path", "left")
    status = F.when(F.col("found").isNull(), "missing_file").when(F.lit(dry_run), "dry_run").otherwise("ok")
    return seen.withColumn("status", status).withColumn("chunks", F.when(F.col("status") == "ok", F.coalesce("chunks", F.lit(0))).otherwise(0)).drop("found")


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: how many documents were ingested, missing, in error."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return results.agg(n("ok", "ingested"), n("missing_file", "missing_file"), n("error", "errors"))


def distinct_jurisdictions(store: DataFrame) -> DataFrame:
    """Codes present in the store."""
    return store.select(F.explode(codes(F.col("jurisdictions"))).alias("jurisdiction")).distinct()


def browse(store: DataFrame, region: str, known: list[str], limit: int = BROWSE_LIMIT) -> DataFrame:
    """The first chunks of a region in store order, with the region's total before the limit. ``known`` are
    the codes a region may have."""
    if region.strip().upper() not in known:
        raise ValueError(f"unknown jurisdiction: {region}")
    if not 1 <= limit <= BROWSE_MOST:
        raise ValueError(f"limit must be between 1 and {BROWSE_MOST}")
    rows = store.where(F.array_contains(codes(F.col("jurisdictions")), region.strip().upper()))
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(*BROWSED, "ord").orderBy("ord").limit(limit).crossJoin(F.broadcast(total))


def counts(store: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: chunks of the store and rows of the inventory."""
    return store.agg(F.count("*").alias("n_chunks")).crossJoin(F.broadcast(inventory.agg(F.count("*").alias("n_documents"))))


def with_source_url(store: DataFrame, inventory: DataFrame) -> DataFrame:
    """Chunks with the address of their document, looked up by document id or else category; of repeated
    inventory rows the last with an address counts."""
    links = inventory.where(~is_blank(F.col("source_url")) & (F.coalesce("document_id", F.lit("")) != "")).groupBy(F.col("document_id").alias("key")).agg(F.max_by(strip(F.col("source_url")), F.col("pos")).alias("source_url"))
    key = F.coalesce(F.when(F.col("document_id") != "", F.col("document_id")), F.col("category"))
    return store.withColumn("key", key).join(links, "key", "left").drop("key")
