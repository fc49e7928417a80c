import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators import dense, evaluate, fusion, lexical, retrieval
from lexloom.session import staging_path

STORE = "id string, ord bigint, text string, category string, jurisdictions array<string>"


def store(spark, texts, **kw):
    return spark.createDataFrame([(f"c{i}", i, t, kw.get("category", {}).get(i, "faq"), kw.get("tags", {}).get(i)) for i, t in enumerate(texts)], STORE)


def index(spark, s):
    return lexical.build_index(s, staging_path(spark, "index"))


def brute_bm25(texts, query, k=24):
    docs = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = []
    for i, d in enumerate(docs):
        tf = Counter(d)
        s = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in re.findall(r"[a-z0-9]+", query.lower()))
        out.append((-round(s, 9), i))
    return [(f"c{i}", -s) for s, i in sorted(out)[:k]]


def test_bm25_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["consent", "data", "biobank", "withdraw", "the", "of", "zebra", "gene", "x1"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 9)]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "data data"]
    queries = [(1, "data consent data"), (2, "zebra"), (3, "nothing here"), (4, "the"), (5, " "), (6, None)]
    got = lexical.bm25_topk(spark.createDataFrame(queries, "query_id bigint, text string"), index(spark, store(spark, texts))).collect()
    for q, text in queries[:4]:
        rows = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute_bm25(texts, text)
        assert [r[1] for r in rows] == [w[0] for w in want]
        assert all(abs(r[2] - w[1]) < 1e-8 for r, w in zip(rows, want))
    assert {r["query_id"] for r in got} == {1, 2, 3, 4}


def test_one_chunk_scores_below_zero(spark):
    one = index(spark, store(spark, ["alpha"]))
    r = lexical.bm25_topk(spark.createDataFrame([(1, "alpha")], "query_id bigint, text string"), one).collect()
    assert len(r) == 1 and r[0]["score"] < 0
    idf = one.terms.first()
    assert round(idf["raw_idf"], 4) == -1.0986 and round(idf["idf"], 4) == -0.2747


def test_negative_scores_rank_below_zero_padding(spark):
    r = lexical.bm25_topk(spark.createDataFrame([(1, "a")], "query_id bigint, text string"), index(spark, store(spark, ["a", "a", "a b", ""])), 4).orderBy("rank").collect()
    assert [x["id"] for x in r] == [w[0] for w in brute_bm25(["a", "a", "a b", ""], "a", 4)]


def test_fusion(spark):
    def run(lists, top=12):
        rows = [(1, n, i, c) for n, ids in enumerate(lists) for i, c in enumerate(ids)]
        return [(r["id"], round(r["fused"], 6)) for r in fusion.fuse(spark.createDataFrame(rows, "query_id int, list_no int, rank int, id string"), top).orderBy("place").collect()]

    assert run([["a", "b"], ["b", "c"]]) == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]
    assert [x[0] for x in run([["a"], ["b"]])] == ["a", "b"]
    assert [x[0] for x in run([["z", "y"], ["y", "z"]])] == ["z", "y"]


def test_dense_order_and_unusable_vectors(spark):
    rows = [("a", 3, [1.0, 0.0]), ("b", 1, [2.0, 0.0]), ("c", 2, [0.0, 1.0]), ("n", 4, None), ("s", 5, [1.0]), ("z", 6, [0.0, 0.0]), ("x", 7, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "id string, ord bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id bigint, embedding array<float>")
    got = dense.knn_topk(q, v, 24, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, "b"), (1, "a"), (1, "c")]
    assert dense.knn_topk(q.where("query_id = 2"), v, 24, 2).count() == 0


def hybrid(spark, prefilter=False, **kw):
    texts = [f"topic {i} consent" for i in range(30)] + ["rare narrow consent"]
    s = store(spark, texts, tags={30: ["eu"], 3: [" EU "], 4: ["SG", ""]}, category={30: "Minutes"})
    v = spark.createDataFrame([(f"c{i}", i, [1.0, float(i)]) for i in range(31)], "id string, ord bigint, embedding array<float>")
    q = spark.createDataFrame([(1, "topic consent", [1.0, 0.0]), (2, "  ", [1.0, 0.0])], "query_id bigint, text string, embedding array<float>")
    kw.setdefault("top_k", 8)
    if prefilter:
        s = s.where(retrieval.passes(kw.pop("category", None), kw.pop("jurisdictions", None)))
        v = v.join(s.select("id"), "id", "left_semi")
    return [(r["query_id"], r["id"], r["place"]) for r in retrieval.hybrid_retrieve(q, s, v, index(spark, s), dim=2, **kw).orderBy("query_id", "place").collect()]


def test_filters_come_after_the_candidates(spark):
    assert [x[1] for x in hybrid(spark)] == [f"c{i}" for i in range(8)]
    # c30 is neither among the 24 nearest nor among the 24 best by words, so the filter can't bring it back
    assert [x[1] for x in hybrid(spark, jurisdictions=["eu"])] == ["c3"]
    assert [x[1] for x in hybrid(spark, jurisdictions=["eu"], prefilter=True)] == ["c3", "c30"]
    assert hybrid(spark, category="MINUTES") == []
    assert [x[1] for x in hybrid(spark, category="MINUTES", prefilter=True)] == ["c30"]


def test_filter_reranks(spark):
    ranked = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 1, 2, "b")], "query_id int, list_no int, rank int, id string")
    assert {(r["id"], r["list_no"], r["rank"]) for r in fusion.rerank(ranked).collect()} == {("a", 0, 0), ("b", 0, 1), ("b", 1, 0)}


def test_bad_k(spark):
    with pytest.raises(ValueError):
        hybrid(spark, top_k=0)


def test_empty_store(spark):
    s = spark.createDataFrame([], STORE)
    v = spark.createDataFrame([], "id string, ord bigint, embedding array<float>")
    q = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id bigint, text string, embedding array<float>")
    assert retrieval.hybrid_retrieve(q, s, v, index(spark, s), dim=2).count() == 0


def test_a_query_reads_no_text_and_one_plan_serves_many(spark):
    texts = [f"word{i % 50} word{i % 7} filler" for i in range(300)]
    at = index(spark, store(spark, texts))
    q = spark.createDataFrame([(i, f"word{i % 60}") for i in range(700)], "query_id bigint, text string")
    found = lexical.bm25_topk(q, at, 3)
    plan = found._jdf.queryExecution().toString()
    assert "text" not in "".join(x for x in plan.splitlines() if "FileScan" in x)
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r["id"])
    assert len(rows) == 700 and all(rows[i] == [x for x, _ in brute_bm25(texts, f"word{i % 60}", 3)] for i in range(0, 700, 41))


def test_more_queries_than_are_sent_along(spark, monkeypatch):
    rng = random.Random(2)
    v = spark.createDataFrame([(f"v{i}", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "id string, ord bigint, embedding array<float>")
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(25)], "query_id bigint, embedding array<float>")
    want = sorted(tuple(r) for r in dense.knn_topk(q, v, 5, 4).collect())
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "SHARE", 20)
    assert len(want) == 125 and sorted(tuple(r) for r in dense.knn_topk(q, v, 5, 4).collect()) == want


def test_needles(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "one two three"), ("b", None), ("c", "twothree"), ("d", "同意 two")], "id string, text string")
    needles = spark.createDataFrame([(1, "two"), (2, "two t"), (3, ""), (4, None), (5, "意 t"), (6, "two"), (7, "zzz")], "query_id bigint, needle string")
    want = {(1, "a"), (1, "c"), (1, "d"), (2, "a"), (5, "d"), (6, "a"), (6, "c"), (6, "d")}
    assert {tuple(r) for r in evaluate.holding(rows, needles).collect()} == want
    monkeypatch.setattr(evaluate, "NEEDLES", 2)
    assert {tuple(r) for r in evaluate.holding(rows, needles).collect()} == want
    assert evaluate.holding(rows, needles.limit(0)).count() == 0


def test_metrics_and_probes(spark):
    hits = spark.createDataFrame([(1, 0, "a", "x\ny"), (1, 1, "b", None), (2, 0, "c", "t")], "query_id int, place int, id string, text string")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (3, "a")], "query_id int, id string")
    m = {r["query_id"]: r for r in evaluate.retrieval_metrics(hits, gold, 2).collect()}
    assert (m[1]["recall_at_k"], m[1]["precision_at_k"], m[1]["reciprocal_rank"]) == (0.5, 0.5, 0.5) and m[3]["reciprocal_rank"] == 0 and 2 not in m
    p = evaluate.probe_rows(hits).where("query_id = 1").first()
    assert p["hit_count"] == 2 and p["top_ids"] == ["a", "b"] and p["snippets"] == ["x y", ""]
    assert hits.select(F.length(evaluate.snippet(F.lit("é" * 500)))).first()[0] == 240
