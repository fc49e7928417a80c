"""Registered queries over the test tables: name -> callable(spark, sf_dir).

Roles: ``chunks`` is the chunk store, ``documents`` are files to chunk and consent texts, ``eval_queries``
the probes, with the vector of the same number in ``embeddings``; ``chunk_vectors`` is the vector table,
``recommendations`` the lines of reports, ``inventory`` the corpus inventory.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chunking, classify, dense, evaluate, evidence, fusion, grounding, inventory, lexical, retrieval
from lexloom.plans import check, ingest
from lexloom.session import numbered, staging_path, table
from lexloom.sources import store as stores
from lexloom.streaming.ingest import start_ingest

CATEGORY, REGIONS = "consent_form", ["SG", "hk "]
#: Vocabulary of the display queries; codes that aren't in it stand for themselves.
LABELS = {"SG": "Singapore", "CN": "Mainland China", "TW": "Taiwan", "KR": "South Korea", "JP": "Japan", "HK": "Hong Kong", "EU": "European Union", "INTL": "everywhere"}
_BUILT: dict = {}


def _store(spark, d):
    return stores.from_manifest(table(spark, d, "chunks"))


def _once(spark, d, name, build):
    """What is stored beside a store (index, vectors) is written once in a session for the tables of a folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _some(store):
    return store.where(retrieval.passes(jurisdictions=REGIONS))


def _index(spark, d, some=False):
    return _once(spark, d, f"index {some}", lambda: lexical.build_index(_some(_store(spark, d)) if some else _store(spark, d), staging_path(spark, "index")))


def _asked(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, d, "eval_queries").join(vectors, "query_id", "left")


def _vectors(spark, d):
    def build():
        rows = dense.usable(table(spark, d, "chunk_vectors")).select("id", "embedding", F.lit("given").alias("embedder")).join(_store(spark, d).select("id", "ord"), "id")
        stores.write_vectors(rows, at := staging_path(spark, "vectors"))
        return at

    return stores.read_vectors(spark, _once(spark, d, "vectors", build), "given")


def _joined(values, sep="|"):
    return F.array_join(values, sep)


def tokens(spark, d):
    """Tokens of every document."""
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def token_stats(spark, d):
    """Corpus and document frequency of every token."""
    t = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token", "doc_id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def chunks(spark, d):
    """Overlapping windows of every document."""
    parts = chunking.overlap_chunks(table(spark, d, "documents"), ["doc_id"])
    return parts.select("doc_id", F.col("window_ix").cast("bigint").alias("chunk_ix"), F.col("start").cast("bigint").alias("start"), F.length("chunk_text").cast("bigint").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


def chunk_ids(spark, d):
    """Ids and metadata of the chunks of files: a source's documents are the pages of one file."""
    pages = table(spark, d, "documents").where("source is not null").select(
        F.concat(F.lit("/corpus/"), F.regexp_replace(F.lower("source"), "[^a-z]+", "-"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("page"), "text", "category", "jurisdiction", "document_id", F.lit(" ").alias("framework")
    )
    return chunking.file_chunks(pages).select("id", "source", "source_path", "page", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), "category", "jurisdiction", "document_id", "framework", F.length("text").cast("bigint").alias("n_chars"))


def manifest_store(spark, d):
    """The chunk store: one row per id."""
    return _store(spark, d).select("id", "ord", F.md5("text").alias("text_md5"), "source", F.col("page").cast("string").alias("page"), "category", _joined("jurisdictions").alias("jurisdictions"), "document_id", "framework")


def bm25_index(spark, d):
    """Document frequency and idf of every term of the store."""
    return _index(spark, d).terms.select("term", "df", F.round("raw_idf", 6).alias("raw_idf"), F.round("idf", 6).alias("idf"))


def bm25_stats(spark, d):
    """Number of chunks and their mean length."""
    return _index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _ranked(df):
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    """The 24 best chunks of every probe by BM25."""
    return _ranked(lexical.bm25_topk(table(spark, d, "eval_queries"), _index(spark, d)))


def bm25_zero_padding(spark, d):
    """BM25 of queries that match few chunks or none: filled up in store order."""
    odd = spark.createDataFrame([(1, "zzzunmatched"), (2, "freezer zzzunmatched freezer"), (3, "  "), (4, None), (5, "xj 1143")], "query_id bigint, text string")
    return _ranked(lexical.bm25_topk(odd, _index(spark, d)))


def _dense(spark, d):
    asked = _asked(spark, d).where(~T.is_blank(F.col("text")))
    return dense.knn_topk(asked, _vectors(spark, d))


def dense_topk(spark, d):
    """The 24 nearest chunks of every probe by cosine."""
    return _ranked(_dense(spark, d))


def rrf(spark, d):
    """Fusion of the dense and the lexical list of every probe."""
    lists = _dense(spark, d).select("query_id", F.lit(0).alias("list_no"), "rank", "id").unionByName(lexical.bm25_topk(table(spark, d, "eval_queries"), _index(spark, d)).select("query_id", F.lit(1).alias("list_no"), "rank", "id"))
    return fusion.fuse(lists, 24).select("query_id", F.col("place").cast("bigint").alias("place"), "id", F.round("fused", 9).alias("fused"))


def _hits(spark, d, **kw):
    return retrieval.hybrid_retrieve(_asked(spark, d), _store(spark, d), _vectors(spark, d), _index(spark, d), **kw)


def _shown(hits):
    return hits.select("query_id", F.col("place").cast("bigint").alias("place"), "id", F.round("fused", 9).alias("fused"), "category", "document_id")


def hybrid(spark, d):
    """Hybrid retrieval of every probe, best 8."""
    return _shown(_hits(spark, d))


def hybrid_category(spark, d):
    """Hybrid retrieval, a category filter after the candidates."""
    return _shown(_hits(spark, d, category=CATEGORY))


def hybrid_jurisdiction(spark, d):
    """Hybrid retrieval, a jurisdiction filter after the candidates."""
    return _shown(_hits(spark, d, jurisdictions=REGIONS))


def hybrid_prefilter(spark, d):
    """Hybrid retrieval among the chunks of some jurisdictions only."""
    some = _some(_store(spark, d))
    return _shown(retrieval.hybrid_retrieve(_asked(spark, d), some, _vectors(spark, d).join(some.select("id"), "id", "left_semi"), _index(spark, d, some=True)))


def eval_probes(spark, d):
    """Probe rows: hits, ids, snippets."""
    p = evaluate.probe_rows(_hits(spark, d))
    return p.select("query_id", "hit_count", _joined("top_ids").alias("top_ids"), F.md5(_joined("snippets")).alias("snippets_md5"))


def retrieval_metrics(spark, d):
    """Recall, precision and reciprocal rank; relevant is a chunk that holds the probe's first 24 characters."""
    q = table(spark, d, "eval_queries").where(~T.is_blank(F.col("text"))).select("query_id", F.substring("text", 1, 24).alias("needle"))
    gold = evaluate.holding(_store(spark, d).select("id", "text"), q)
    m = evaluate.retrieval_metrics(_hits(spark, d), gold)
    return m.select("query_id", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("precision_at_k", 6).alias("precision_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def evidence_pack(spark, d):
    """Evidence text of every probe's hits within the budget."""
    p = evidence.pack(_hits(spark, d), 6000)
    return p.select("query_id", "n_chunks", "used_chars", F.md5("evidence").alias("evidence_md5"))


def chunk_cards(spark, d):
    """Card text and snippet of every chunk."""
    return _store(spark, d).select("id", F.md5(F.substring(F.coalesce("text", F.lit("")), 1, evaluate.CARD_CHARS)).alias("card_md5"), F.md5(evaluate.snippet(F.col("text"))).alias("snippet_md5"))


def list_jurisdictions(spark, d):
    """Jurisdiction codes present in the store."""
    return inventory.distinct_jurisdictions(_store(spark, d))


def jurisdiction_options(spark, d):
    """Display label of every raw jurisdiction of the store."""
    raw = table(spark, d, "chunks").select(F.col("metadata.jurisdiction").alias("raw")).where("raw is not null").distinct()
    return raw.select("raw", inventory.option_label(F.col("raw"), LABELS).alias("label"))


def jurisdiction_filters(spark, d):
    """Normalised filter list and scope label of every inventory row."""
    c = T.codes(F.col("jurisdiction"))
    return table(spark, d, "inventory").select("pos", _joined(c).alias("codes"), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("all jurisdictions").alias("scope"))


def browse_region(spark, d):
    """First chunks of a region, with the total."""
    shown = inventory.browse(_store(spark, d), "HK", list(LABELS), 25)
    return shown.withColumns({"text": F.md5("text"), "jurisdictions": _joined("jurisdictions"), "page": F.col("page").cast("string")})


def label_codes(spark, d):
    """Codes of the labels chosen on display, for every inventory row."""
    shown = F.transform(F.filter("jurisdiction", lambda x: x.isNotNull()), lambda x: inventory.option_label(x, LABELS))
    return table(spark, d, "inventory").select("pos", _joined(inventory.codes_of_labels(shown, LABELS)).alias("codes"))


def store_counts(spark, d):
    """Number of chunks and of inventory rows."""
    return inventory.counts(_store(spark, d), table(spark, d, "inventory"))


def source_links(spark, d):
    """Address of every chunk's document."""
    return inventory.with_source_url(_store(spark, d), table(spark, d, "inventory")).select("id", "source_url")


def corpus_listing(spark, d):
    """Display rows of the inventory."""
    return inventory.listing(table(spark, d, "inventory"))


def corpus_region(spark, d):
    """Display rows of a region's inventory."""
    return inventory.listing(table(spark, d, "inventory"), "eu")


def inventory_by_tier(spark, d):
    """Documents by tier."""
    return inventory.by_tier(table(spark, d, "inventory"))


def batch_selection(spark, d):
    """Documents to ingest, with their sort key and primary jurisdiction."""
    return inventory.select_for_ingest(table(spark, d, "inventory")).withColumn("tier_rank", F.col("tier_rank").cast("bigint"))


def batch_selection_tier(spark, d):
    """Documents of one tier to ingest again."""
    return inventory.select_for_ingest(table(spark, d, "inventory"), tier="p2", skip_ingested=False).withColumn("tier_rank", F.col("tier_rank").cast("bigint"))


def _batch(spark, d):
    inv = table(spark, d, "inventory")
    held = _store(spark, d).where("source_path is not null").groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("chunks"))
    return inventory.ingest_results(inventory.select_for_ingest(inv, skip_ingested=False), held, held)


def ingest_results(spark, d):
    """Status and chunks of every selected document; a file is present if the store has chunks of its path."""
    return _batch(spark, d).select("pos", "document_id", "status", "chunks")


def ingest_summary(spark, d):
    """Counts of the batch by status."""
    return inventory.ingest_summary(_batch(spark, d))


def study_type(spark, d):
    """Study kind of every document."""
    return table(spark, d, "documents").select("doc_id", classify.study(F.col("text")).alias("s")).select("doc_id", "s.study_type", F.col("s.best_score").cast("bigint").alias("best_score"))


def keyword_gap(spark, d):
    """Missing elements and status of every document."""
    m = classify.missing_elements(F.col("text"))
    return table(spark, d, "documents").select("doc_id", _joined(m).alias("missing"), F.size(m).cast("bigint").alias("n_missing"), classify.gap_status(m).alias("status"))


def _reports(spark, d):
    asked = table(spark, d, "eval_queries").select(F.col("query_id").alias("report_id"), "text")
    hit = _hits(spark, d).groupBy(F.col("query_id").alias("report_id")).agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("x")).select("report_id", F.transform("x", lambda v: v["id"]).alias("ids"))
    return classify.fallback_report(asked, hit)


def fallback_report(spark, d):
    """Report without a model for every probe; blank probes get the empty-store report."""
    r = _reports(spark, d)
    return r.select("report_id", "study_type", "status", _joined("missing_elements").alias("missing"), F.size("recommendations").cast("bigint").alias("n_recommendations"), F.size("citations").cast("bigint").alias("n_citations"), "grounding_ok", _joined("issues").alias("issues"), F.col("grounding_attempts").cast("bigint").alias("grounding_attempts"))


def fallback_recommendations(spark, d):
    """Recommendations of those reports and the chunk each cites."""
    r = _reports(spark, d).select("report_id", F.posexplode("recommendations").alias("rec_no", "x"))
    return r.select("report_id", F.col("rec_no").cast("bigint").alias("rec_no"), F.col("x.text").alias("text"), _joined("x.evidence_chunk_ids").alias("evidence"))


def fallback_citations(spark, d):
    """Citations of those reports."""
    r = _reports(spark, d).select("report_id", F.posexplode("citations").alias("no", "x"))
    return r.select("report_id", F.col("no").cast("bigint").alias("no"), F.col("x.chunk_id").alias("chunk_id"), F.col("x.reason").alias("reason"))


def _recall(spark, d):
    return grounding.token_recall(table(spark, d, "recommendations"), _store(spark, d))


def token_recall(spark, d):
    """Best token recall of every recommendation over its cited chunks."""
    return _recall(spark, d).select("report_id", "rec_no", F.round("score", 6).alias("score"))


def overlap_filter(spark, d):
    """Recommendations kept or dropped by token recall."""
    return grounding.overlap_filter(_recall(spark, d), 0.3).select("report_id", "rec_no", "kept", "reason", F.round("score", 6).alias("score"))


def overlap_stats(spark, d):
    """Counts of kept and dropped recommendations per report."""
    s = grounding.overlap_stats(grounding.overlap_filter(_recall(spark, d), 0.3), 0.3)
    return s.select("report_id", "input_count", "kept_count", "dropped_count", "dropped_all", F.array_join(F.transform("dropped", lambda x: x["rec_no"].cast("string")), "|").alias("dropped"))


def _audit(spark, d, citations=None):
    return grounding.audit(table(spark, d, "recommendations"), _store(spark, d).select("id"), citations)


def grounding_audit(spark, d):
    """Issues of every report; allowed are the ids of the store."""
    a = _audit(spark, d)
    return a.select("report_id", "ok", _joined("issues", "\n").alias("issues"), "recommendation_count", _joined("invalid_evidence_chunk_ids").alias("invalid"))


def citation_audit(spark, d):
    """Audit with supplementary citations: every odd line's first evidence id, every third line no object."""
    r = table(spark, d, "recommendations")
    c = r.select("report_id", F.col("rec_no").alias("citation_no"), (F.col("rec_no") % 3 != 2).alias("is_object"), F.when(F.col("rec_no") % 3 != 2, F.get("evidence_chunk_ids", F.lit(0))).alias("chunk_id"))
    a = _audit(spark, d, c)
    return a.select("report_id", "ok", F.size("issues").cast("bigint").alias("n_issues"), F.md5(_joined("issues", "\n")).alias("issues_md5"), "citation_count", _joined("valid_citation_chunk_ids").alias("valid"))


def _raw_items(spark, d):
    r = table(spark, d, "recommendations").select("report_id", "rec_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")).alias("ids"))
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    ids = F.to_json("ids")
    kind = F.col("rec_no") % 4
    item = (
        F.when(kind == 0, F.concat(F.lit('{"text":'), quoted, F.lit(',"evidence_chunk_ids":'), ids, F.lit("}")))
        .when(kind == 1, quoted)
        .when(kind == 2, F.concat(F.lit('{"text":"","recommendation":'), quoted, F.lit(',"chunk_ids":'), ids, F.lit("}")))
        .otherwise(F.lit("17"))
    )
    listed = r.select("report_id", "rec_no", item.alias("item")).groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("rec_no", "item"))).alias("x"))
    return listed.select("report_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["item"]), ","), F.lit("]")).alias("json"))


def normalise_recs(spark, d):
    """Recommendations of loosely typed report JSON: objects, plain texts, alternate keys, junk."""
    items = _raw_items(spark, d).select("report_id", F.posexplode(grounding.normalise_items(F.parse_json("json"))).alias("i", "x"))
    return items.select("report_id", F.col("i").cast("bigint").alias("i"), F.col("x.text").alias("text"), _joined("x.evidence_chunk_ids").alias("evidence"))


def report_salvage(spark, d):
    """Fields of report answers that are JSON, JSON inside prose, no JSON or broken JSON."""
    r = table(spark, d, "recommendations").select("report_id").distinct()
    n = F.col("report_id").cast("string")
    raw = (
        F.when(F.col("report_id") % 4 == 0, F.concat(F.lit('{"status":"Compliant","study_type":"kind '), n, F.lit('","missing_elements":["cloud"],"notes":""}')))
        .when(F.col("report_id") % 4 == 1, F.concat(F.lit('Sure: {"status":"Non-Compliant","notes":"n'), n, F.lit('"} done')))
        .when(F.col("report_id") % 4 == 2, F.lit("no answer"))
        .otherwise(F.lit('{"status": oops}'))
    )
    x = r.select("report_id", grounding.coerce_report(raw, F.lit("unspecified")).alias("x"))
    return x.select("report_id", "x.study_type", "x.status", _joined("x.missing_elements").alias("missing"), "x.notes", F.size("x.recommendations").cast("bigint").alias("n_recommendations"), "x.parse_failed")


def final_attempts(spark, d):
    """First grounded attempt of every report, else the last: a report's lines are its attempts here."""
    s = grounding.overlap_filter(_recall(spark, d), 0.3).select("report_id", (F.col("rec_no") + 1).alias("attempt"), F.col("kept").alias("ok"))
    return grounding.final_attempt(s, 2)


def review_flags(spark, d):
    """Whether a person should review a report, and why."""
    s = _recall(spark, d).groupBy("report_id").agg(F.count_if(F.size("evidence_chunk_ids") > 0).alias("n_hits"), F.min("score").alias("low"))
    a = _audit(spark, d).select("report_id", "ok")
    flag = grounding.review_flag(F.col("n_hits"), F.col("ok"), F.col("low"), weak=2)
    return s.join(a, "report_id").select("report_id", flag.isNotNull().alias("needs_human_review"), flag.alias("reason"))


def chat_window(spark, d):
    """Chat history: a report's lines as a conversation of user, assistant and system turns, last 3."""
    m = table(spark, d, "recommendations").select(F.col("report_id").alias("conv_id"), F.col("rec_no").alias("turn"), F.element_at(F.array(*map(F.lit, ("user", "assistant", "system"))), F.col("rec_no") % 3 + 1).alias("role"), "text")
    return evidence.chat_history(m, 3)


def chat_prompt(spark, d):
    """Chat messages for a generator: a system message with evidence, then the history."""
    m = table(spark, d, "recommendations").select(F.col("report_id").alias("conv_id"), F.col("rec_no").alias("turn"), F.lit("user").alias("role"), "text")
    consents = table(spark, d, "eval_queries").select(F.col("query_id").alias("conv_id"), "text")
    history = evidence.chat_history(m.join(consents.select("conv_id"), "conv_id", "left_semi"))
    p = evidence.chat_prompt(evidence.pack(_hits(spark, d)), consents, history)
    return p.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def _document_pages(docs):
    """``documents`` as pages of one file each, numbered by ``doc_id``."""
    path = F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.lit(0).alias("page"), "text", "category", "jurisdiction", "document_id", F.lit(None).cast("string").alias("framework"), F.col("doc_id").alias("doc_no"))


def _stored(rows):
    return rows.select("id", "ord", F.md5("text").alias("text_md5"), "source", "source_path", "page", "category", _joined("jurisdictions").alias("jurisdictions"), "document_id")


def stream_ingest(spark, d):
    """Documents read as a stream, chunked and appended to a chunk store; the store's rows."""
    at = staging_path(spark, "stream")
    schema = table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(d if not _is_folder(d) else f"{d}/documents.parquet")
    docs = docs.where(F.col("_metadata.file_path").contains("/documents.parquet"))
    start_ingest(_document_pages(docs), f"{at}/store", f"{at}/checkpoint").awaitTermination()
    return _stored(stores.read_store(spark, f"{at}/store"))


def ingest_store(spark, d):
    """A source's documents as the pages of one file, taken into a chunk store; the store's rows."""
    name = F.concat(F.lit("/corpus/"), F.regexp_replace(F.lower("source"), "[^a-z]+", "-"), F.lit(".txt"))
    pages = table(spark, d, "documents").where("source is not null").select(name.alias("path"), F.col("doc_id").alias("page"), "text", "category", "jurisdiction", "document_id")
    about = pages.groupBy("path").agg(*(F.min(c).alias(c) for c in ("category", "jurisdiction", "document_id")), F.lit(None).cast("string").alias("framework"))
    at = ingest.Store(staging_path(spark, "store"))
    ingest.add_chunks(ingest.chunk_rows(pages, numbered(about, ["path"], "position"), 0), at)
    return _stored(stores.read_store(spark, at.chunks))


def ingest_batch(spark, d):
    """Status and chunks of every inventory row, its files' pages being the store's records of the same path."""
    pages = _store(spark, d).where("source_path is not null").select(F.col("source_path").alias("path"), F.col("ord").alias("page"), "text")
    done = ingest.ingest_batch(table(spark, d, "inventory"), pages, ingest.Store(staging_path(spark, "store")), force=True)
    return done.select("pos", "document_id", "status", "chunks")


def _answered(spark, d):
    """Texts, hits and answers made of the report lines: a report's text is its lines, its hits are the stored chunks
    they cite; the first answer holds all lines (and a wrong citation in every fifth report), the second the sound ones.
    In every fifth report the model failed, in every fifth nothing was retrieved."""
    lines = table(spark, d, "recommendations").select("report_id", "rec_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")).alias("ids"))
    listed = lambda x: F.sort_array(F.collect_list(x))
    texts = lines.groupBy("report_id").agg(listed(F.struct("rec_no", "text")).alias("x")).select("report_id", F.array_join(F.transform("x", lambda v: v["text"]), " ").alias("text"), F.when(F.col("report_id") % 5 == 3, "offline").alias("error"))
    store = _store(spark, d).select("id", F.col("text").alias("chunk_text"))
    cited = lines.where("report_id % 5 <> 4").select("report_id", "rec_no", F.posexplode("ids").alias("at", "id")).groupBy("report_id", "id").agg(F.min(F.col("rec_no") * 1000 + F.col("at")).alias("place"))
    hits = cited.join(store, "id").select("report_id", "place", "id", F.col("chunk_text").alias("text"))
    known = lines.select("report_id", "rec_no", F.explode("ids").alias("id")).join(hits.select("report_id", "id"), ["report_id", "id"], "left_anti").select("report_id", "rec_no").distinct().withColumn("wrong", F.lit(True))
    marked = lines.join(known, ["report_id", "rec_no"], "left").withColumn("sound", F.col("wrong").isNull() & (F.size("ids") > 0) & ~T.is_blank(F.col("text")))
    item = F.to_json(F.struct("text", F.col("ids").alias("evidence_chunk_ids")))
    each = marked.groupBy("report_id").agg(listed(F.struct("rec_no", item.alias("j"))).alias("every"), listed(F.when(F.col("sound"), F.struct("rec_no", item.alias("j")))).alias("good"))
    body = lambda c: F.concat(F.lit('"recommendations":['), F.array_join(F.transform(c, lambda v: v["j"]), ","), F.lit("]}"))
    head = F.lit('{"status":"Compliant","study_type":"given","missing_elements":["cloud"],')
    wrong = F.when(F.col("report_id") % 5 == 1, F.lit('"citations":[{"chunk_id":"nowhere"}],')).otherwise("")
    one = each.select("report_id", F.lit(1).alias("attempt"), F.concat(head, wrong, body("every")).alias("raw"))
    two = each.select("report_id", F.lit(2).alias("attempt"), F.concat(F.lit("Sure: "), head, body("good"), F.lit(" done")).alias("raw"))
    return texts, hits, one.union(two)


def check_reports(spark, d):
    """Final reports of raw answers: salvage, audit, overlap, attempts, and reports without a model."""
    r = check.check_reports(*_answered(spark, d), min_overlap=0.3)
    recs = F.array_join(F.transform("recommendations", lambda x: F.concat(x["text"], F.lit(" "), F.array_join(x["evidence_chunk_ids"], "|"))), "\n")
    return r.select("report_id", "made_by", "study_type", "status", "grounding_ok", F.size("issues").cast("bigint").alias("n_issues"), "allowed_chunk_count", "recommendation_count", "grounding_attempts", "dropped_all", F.when(F.col("made_by") == "model", F.md5(recs)).alias("recommendations_md5"))


def audit_empty_reports(spark, d):
    """Audit and overlap counts where some reports have no recommendation, or ones that can't be read."""
    reports = table(spark, d, "eval_queries").select((-F.col("query_id")).alias("report_id"), (F.col("query_id") % 3 == 0).alias("unparsed"))
    recs = table(spark, d, "recommendations")
    reports = reports.union(recs.select("report_id", F.lit(False)).distinct())
    a = grounding.audit(recs, _store(spark, d).select("id"), reports=reports)
    s = grounding.overlap_stats(grounding.overlap_filter(_recall(spark, d), 0.3), 0.3, reports)
    return a.join(s, "report_id").select("report_id", "ok", F.size("issues").cast("bigint").alias("n_issues"), "allowed_chunk_count", "recommendation_count", "input_count", "kept_count", "dropped_all", F.round(F.aggregate("kept", F.lit(0.0), lambda t, x: t + x["overlap_score"]), 3).alias("kept_scores"))


def _is_folder(d: str) -> bool:
    import os

    return os.path.isdir(os.path.join(d, "documents.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens, token_stats, chunks, chunk_ids, manifest_store, bm25_index, bm25_stats, bm25_topk, bm25_zero_padding, dense_topk, rrf, hybrid, hybrid_category, hybrid_jurisdiction, hybrid_prefilter,
        eval_probes, retrieval_metrics, evidence_pack, chunk_cards, list_jurisdictions, jurisdiction_options, jurisdiction_filters, browse_region, label_codes, store_counts, source_links, corpus_listing, corpus_region,
        inventory_by_tier, batch_selection, batch_selection_tier, ingest_results, ingest_summary, study_type, keyword_gap, fallback_report, fallback_recommendations, fallback_citations,
        token_recall, overlap_filter, overlap_stats, grounding_audit, citation_audit, normalise_recs, report_salvage, final_attempts, review_flags, chat_window, chat_prompt, stream_ingest, ingest_store, ingest_batch, check_reports, audit_empty_reports,
    )
}
