import json

from pyspark.sql import functions as F

from lexloom.operators import classify, evidence, grounding
from lexloom.plans import check

REC = "report_id int, rec_no int, text string, evidence_chunk_ids array<string>"


def kind(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(classify.study_type(F.col("t"))).first()[0]


def test_study_types(spark):
    assert kind(spark, "Whole genome sequencing of variant carriers") == "genomic_research"
    assert kind(spark, "western blot") == "genomic_research"
    assert kind(spark, "a gene panel") == "genomic_research"
    assert kind(spark, "generic text") == "unspecified"
    assert kind(spark, "  ") == "unspecified" and kind(spark, None) == "unspecified"
    assert kind(spark, "Phase III cohort with registry") == "clinical_trial"
    assert kind(spark, "biobank with genome data") == "biobank"


def test_keyword_gap(spark):
    row = spark.createDataFrame([("You may WITHDRAW.",), ("secondary use recontact withdraw international cloud",), (None,)], "t string").select(classify.missing_elements(F.col("t")).alias("m"), classify.gap_status(classify.missing_elements(F.col("t"))).alias("s")).collect()
    assert len(row[0]["m"]) == 7 and row[0]["s"] == "Non-Compliant"
    assert row[1]["m"] == ["data sharing", "identifiable", "pseudonym"] and row[1]["s"] == "Partially Compliant"
    assert len(row[2]["m"]) == 8


def test_fallback_reports(spark):
    texts = spark.createDataFrame([(1, "biobank"), (2, "x"), (3, None)], "report_id int, text string")
    ids = spark.createDataFrame([(1, ["a", "b"]), (3, [str(i) for i in range(9)])], "report_id int, ids array<string>")
    r = {x["report_id"]: x for x in classify.fallback_report(texts, ids).collect()}
    assert [y["evidence_chunk_ids"] for y in r[1]["recommendations"]] == [["a"], ["b"], ["a"]]
    assert r[1]["grounding_ok"] and r[1]["grounding_attempts"] == 1 and len(r[1]["citations"]) == 2
    assert r[2]["status"] == "Unknown" and not r[2]["grounding_ok"] and r[2]["grounding_attempts"] == 0 and len(r[2]["recommendations"]) == 1
    assert len(r[3]["citations"]) == 5
    assert r[1]["allowed_chunk_count"] == 2 and r[1]["recommendation_count"] == 3 and r[1]["overlap_skipped"] and not r[2]["overlap_skipped"] and len(r[2]["issues"]) == 1
    bare = spark.createDataFrame([(1, [])], "report_id int, ids array<string>")
    failed = texts.where("report_id = 1").selectExpr("*", "'no route' as error")
    assert not classify.fallback_report(texts.where("report_id = 1"), bare).first()["grounding_ok"]
    own = classify.fallback_report(failed, ids, advice=["one", ""], note_after_error="N").first()
    assert own["notes"] == "N (no route)" and [y["text"] for y in own["recommendations"]] == ["one", ""] and own["issues"] == ["recommendations[1] has empty text."]


def test_reports_without_recommendations(spark):
    recs = spark.createDataFrame([(1, 0, "t", ["a"])], REC)
    allowed = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    reports = spark.createDataFrame([(1, False), (2, False), (3, True)], "report_id int, unparsed boolean")
    a = {r["report_id"]: r for r in grounding.audit(recs, allowed, reports=reports).collect()}
    assert a[2]["ok"] and a[2]["recommendation_count"] == 0 and a[1]["allowed_chunk_count"] == a[2]["allowed_chunk_count"] == 2
    assert a[3]["issues"] == [grounding.UNPARSED]
    scored = grounding.token_recall(recs, spark.createDataFrame([("a", "t")], "id string, text string"))
    s = {r["report_id"]: r for r in grounding.overlap_stats(grounding.overlap_filter(scored), reports=reports).collect()}
    assert s[2]["input_count"] == 0 and not s[2]["dropped_all"] and s[2]["kept"] == [] and s[1]["kept"][0]["overlap_score"] == 1.0


def checked(spark, answers, **kw):
    texts = spark.createDataFrame([(i, "biobank data", "down" if i == 9 else None) for i in range(1, 10)], "report_id int, text string, error string")
    hits = spark.createDataFrame([(i, 0, "a", "withdrawal of consent") for i in range(1, 10) if i != 8] + [(1, 1, "b", "other words")], "report_id int, place int, id string, text string")
    given = spark.createDataFrame([(i, n, raw if isinstance(raw, str) else json.dumps(raw)) for i, n, raw in answers], "report_id int, attempt int, raw string")
    return {r["report_id"]: r for r in check.check_reports(texts, hits, given, **kw).collect()}


def test_check_from_raw_answers(spark):
    good = {"status": "Compliant", "recommendations": [{"text": "explain withdrawal", "evidence_chunk_ids": ["a"]}, {"text": "zebra", "evidence_chunk_ids": ["a"]}], "citations": [{"chunk_id": "a", "reason": "r"}]}
    off = {"recommendations": [{"text": "zebra", "evidence_chunk_ids": ["a"]}], "notes": "mine"}
    unknown = {"recommendations": [{"text": "t", "evidence_chunk_ids": ["b"]}]}
    r = checked(spark, [(1, 1, good), (2, 1, unknown), (2, 2, "So: " + json.dumps(good) + "."), (3, 1, off), (3, 2, off), (4, 1, {"recommendations": "junk"}), (4, 2, {"recommendations": []}), (5, 1, "nothing"), (6, 1, unknown), (6, 2, {**unknown, "citations": ["x"]}), (6, 3, good), (9, 1, good)])
    assert len(r) == 9
    assert r[1]["grounding_ok"] and r[1]["grounding_attempts"] == 1 and [(x["text"], x["overlap_score"]) for x in r[1]["recommendations"]] == [("explain withdrawal", 0.5)] and r[1]["dropped_count"] == 1 and r[1]["allowed_chunk_count"] == 2
    assert r[1]["citations"][0]["reason"] == "r" and r[1]["study_type"] == "biobank" and r[1]["notes"] is None
    assert r[2]["grounding_ok"] and r[2]["grounding_attempts"] == 2 and r[2]["allowed_chunk_count"] == 1
    assert not r[3]["grounding_ok"] and r[3]["dropped_all"] and r[3]["grounding_attempts"] == 2 and r[3]["recommendations"] == [] and r[3]["notes"].startswith("mine ") and len(r[3]["issues"]) == 1
    assert r[4]["grounding_ok"] and r[4]["grounding_attempts"] == 2 and r[4]["recommendation_count"] == 0
    assert r[5]["grounding_ok"] and r[5]["parse_failed"] and r[5]["recommendations"] == []
    assert not r[6]["grounding_ok"] and r[6]["grounding_attempts"] == 2 and r[6]["issues"] == ["Invalid evidence_chunk_ids (not in retrieved set): ['b']", "citations[0] is not an object."] and r[6]["recommendations"][0]["text"] == "t"
    assert r[7]["made_by"] == "keywords" and r[7]["grounding_ok"] and r[8]["made_by"] == "empty store" and not r[8]["grounding_ok"] and r[8]["grounding_attempts"] == 0
    assert r[9]["made_by"] == "keywords" and "(down)" in r[9]["notes"]
    lax = checked(spark, [(4, 1, {"recommendations": "junk"})], flag_unparsed=False)[4]
    assert lax["grounding_ok"] and lax["parse_warning"] and lax["grounding_attempts"] == 1
    assert not checked(spark, [(4, 1, {"recommendations": "junk"})], max_attempts=1)[4]["grounding_ok"]


def items(spark, value):
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    return [tuple(x) for x in df.select(grounding.normalise_items(F.parse_json("j"))).first()[0]]


def test_normalise(spark):
    assert items(spark, ["a", {"text": "b", "evidence_chunk_ids": ["x"]}]) == [("a", []), ("b", ["x"])]
    assert items(spark, {"text": "b"}) == [] and items(spark, "b") == [] and items(spark, 3) == []
    assert items(spark, [1, None, ["q"], " s "]) == [("s", [])]
    assert items(spark, [{"text": "", "recommendation": "r", "evidence_chunk_ids": [], "chunk_ids": ["k", 1]}]) == [("r", ["k", "1"])]
    assert items(spark, [{"text": "t", "evidence_chunk_ids": "zz", "chunk_ids": ["k"]}]) == [("t", [])]
    assert items(spark, [{"evidence_chunk_ids": None}]) == [("", [])]


def report(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(grounding.coerce_report(F.col("r"), F.lit("guess")).alias("x")).first()["x"]


def test_salvage(spark):
    x = report(spark, 'Here: {"status": "Compliant", "recommendations": ["a"], "notes": "n"} bye')
    assert x["status"] == "Compliant" and x["study_type"] == "guess" and x["notes"] == "n" and len(x["recommendations"]) == 1 and not x["parse_failed"]
    for raw in ("nothing", "{broken", "[1]", "{a: }"):
        x = report(spark, raw)
        assert x["status"] == "Unknown" and x["recommendations"] == [] and x["parse_failed"], raw
    assert not report(spark, None)["parse_failed"] and not report(spark, "{}")["parse_failed"]
    x = report(spark, '{"recommendations": "junk", "missing_elements": null}')
    assert x["unparsed"] and x["missing_elements"] == [] and x["recommendations"] == []


def test_recall_and_overlap(spark):
    store = spark.createDataFrame([("a", "withdrawal of consent must be possible"), ("b", None), ("c", "other")], "id string, text string")
    recs = spark.createDataFrame([(1, 0, "Withdrawal consent possible xyz", ["a", "c", "zz"]), (1, 1, "quantum flux", ["a"]), (1, 2, "x", []), (1, 3, None, ["a"]), (1, 4, "other", ["b"]), (2, 0, "other other", ["c", "c"])], REC)
    scored = grounding.token_recall(recs, store)
    s = {(r["report_id"], r["rec_no"]): r["score"] for r in scored.collect()}
    assert s == {(1, 0): 0.75, (1, 1): 0.0, (1, 2): 0.0, (1, 3): 0.0, (1, 4): 0.0, (2, 0): 1.0}
    f = {(r["report_id"], r["rec_no"]): r["reason"] for r in grounding.overlap_filter(scored, 0.06).collect()}
    assert f[1, 0] is None and f[1, 1] == "low_token_overlap" and f[1, 2] == "no_evidence_chunk_ids"
    free = {(r["report_id"], r["rec_no"]): r["kept"] for r in grounding.overlap_filter(scored, 0).collect()}
    assert free[1, 1] and not free[1, 2]
    stats = {r["report_id"]: r for r in grounding.overlap_stats(grounding.overlap_filter(scored, 0.15)).collect()}
    assert stats[1]["dropped_count"] == 4 and not stats[1]["dropped_all"] and [d["rec_no"] for d in stats[1]["dropped"]] == [1, 2, 3, 4]


def test_threshold_compares_unrounded(spark):
    scored = spark.createDataFrame([(1, 0, "t", ["a"], 0.05999999)], REC + ", score double")
    assert grounding.overlap_filter(scored, 0.06).first()["reason"] == "low_token_overlap"


def test_audit(spark):
    recs = spark.createDataFrame([(1, 0, "ok", ["a"]), (2, 0, " ", []), (2, 5, "t", ["q", "a", "q", "p"]), (3, 0, "t", ["a"])], REC)
    allowed = spark.createDataFrame([("a",)], "id string")
    a = {r["report_id"]: r for r in grounding.audit(recs, allowed).collect()}
    assert a[1]["ok"] and a[1]["issues"] == []
    assert a[2]["issues"] == ["recommendations[0] has empty text.", "recommendations[0] has empty evidence_chunk_ids.", "Invalid evidence_chunk_ids (not in retrieved set): ['q', 'p']"]
    assert a[2]["invalid_evidence_chunk_ids"] == ["q", "p"] and a[2]["recommendation_count"] == 2
    lax = {r["report_id"]: r for r in grounding.audit(recs, allowed, require_evidence=False).collect()}
    assert len(lax[2]["issues"]) == 2
    c = spark.createDataFrame([(1, 0, True, "a"), (1, 1, False, None), (1, 2, True, "zz"), (1, 3, True, None), (1, 4, True, "a")], "report_id int, citation_no int, is_object boolean, chunk_id string")
    a = {r["report_id"]: r for r in grounding.audit(recs, allowed, c).collect()}
    assert a[1]["issues"] == ["citations[1] is not an object.", "citations[2] invalid chunk_id: 'zz'"] and a[1]["valid_citation_chunk_ids"] == ["a", "a"] and a[1]["citation_count"] == 5
    own = spark.createDataFrame([(3, "b"), (1, "a")], "report_id int, id string")
    a = {r["report_id"]: r["ok"] for r in grounding.audit(recs, own).collect()}
    assert a == {1: True, 2: False, 3: False}


def test_attempts(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False), (2, 3, True), (3, 1, True), (3, 2, False)]
    got = {r["report_id"]: (r["attempt"], r["ok"]) for r in grounding.final_attempt(spark.createDataFrame(rows, "report_id int, attempt int, ok boolean"), 2).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (1, True)}


def test_evidence_budget(spark):
    rows = [(1, i, f"c{i}", "x" * 50, "s", 0, "k") for i in range(5)] + [(2, 0, "d", None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id int, place int, id string, text string, source string, page int, category string")
    size = len("[chunk_id=c0 source=s page=0 category=k]\n" + "x" * 50 + "\n")
    p = {r["query_id"]: r for r in evidence.pack(df, 2 * size + 1).collect()}
    assert p[1]["n_chunks"] == 2 and p[1]["used_chars"] == 2 * size and p[1]["evidence"].count("\n\n") == 1
    assert p[2]["evidence"] == "[chunk_id=d source=? page=0 category=?]"
    none = {r["query_id"]: r for r in evidence.pack(df, 45).collect()}
    assert (none[1]["n_chunks"], none[1]["used_chars"], none[1]["evidence"]) == (0, 0, "") and none[2]["n_chunks"] == 1


def test_chat_window_cuts_before_it_filters(spark):
    rows = [(1, t, role, text) for t, (role, text) in enumerate([("user", "old"), ("user", "a"), ("system", "s"), ("assistant", " "), ("assistant", "b ")])]
    got = evidence.chat_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 4).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "a"), ("assistant", "b")]


def test_review_flag(spark):
    rows = [(1, True, 1.0), (5, False, 1.0), (5, True, 0.1), (5, True, 0.5)]
    df = spark.createDataFrame(rows, "n int, ok boolean, low double")
    assert [r[0] for r in df.select(grounding.review_flag(F.col("n"), F.col("ok"), F.col("low"))).collect()] == ["weak_retrieval", "grounding_failed", "low_overlap", None]
