import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chunking


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


def test_tokens(spark):
    assert one(spark, "Data Sharing (v2)", T.tokens) == ["data", "sharing", "v2"]
    assert one(spark, "a b a", T.tokens) == ["a", "b", "a"]
    assert one(spark, "İx", T.tokens) == re.findall(r"[a-z0-9]+", "İx".lower())
    assert one(spark, None, T.tokens) == []


def test_strip_takes_every_white_space(spark):
    spaces = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, spaces + "a b" + spaces, T.strip) == "a b"
    assert one(spark, "​a", T.strip) == "​a"
    assert one(spark, spaces, T.is_blank) is True
    assert one(spark, None, T.is_blank) is True


def test_newlines(spark):
    assert one(spark, "a\r\nb\rc\nd", T.unified_newlines) == "a\nb\nc\nd"


def test_codes(spark):
    assert one(spark, [" sg", "SG", "", None, "cn "], T.codes, "array<string>") == ["SG", "CN"]
    assert one(spark, None, T.codes, "array<string>") == []


def loop(text, size, overlap):
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        out.append((start, text[start:end]))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def test_windows_equal_the_loop(spark):
    texts = [(n, "".join(chr(97 + k % 26) for k in range(n))) for n in [0, 1, 29, 30, 31, 50, 51, 100, 777]]
    df = spark.createDataFrame(texts, "id int, text string")
    for size, overlap in ((30, 10), (30, 0), (30, 30), (30, 45), (7, 6)):
        got = {}
        for r in chunking.overlap_chunks(df, ["id"], "text", size, overlap).collect():
            got.setdefault(r["id"], []).append((r["start"], r["chunk_text"]))
        for n, text in texts:
            assert sorted(got.get(n, [])) == loop(text, size, overlap), (n, size, overlap)


def test_window_counts(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 900, 901, 1650, 1651)], "n int, text string")
    counts = {r["n"]: r["k"] for r in chunking.overlap_chunks(df, ["n"]).groupBy("n").agg(F.count("*").alias("k")).collect()}
    assert counts == {900: 1, 901: 2, 1650: 2, 1651: 3}


def test_emoji_count_as_one(spark):
    df = spark.createDataFrame([("🙂" * 12,)], "text string")
    assert [r["chunk_text"] for r in chunking.overlap_chunks(df, [], "text", 10, 2).orderBy("start").collect()] == ["🙂" * 10, "🙂" * 4]


def test_chunk_index_runs_across_pages(spark):
    pages = spark.createDataFrame([("/a/Doc.v1.txt", 1, "x" * 1000, " ", "eu ", None, ""), ("/a/Doc.v1.txt", 2, "y" * 100, None, None, "d", "f")], "path string, page int, text string, category string, jurisdiction string, document_id string, framework string")
    rows = chunking.file_chunks(pages).orderBy("chunk_ix").collect()
    assert [(r["page"], r["chunk_ix"]) for r in rows] == [(1, 0), (1, 1), (2, 2)]
    assert rows[0]["category"] == "Doc.v1" and rows[0]["jurisdiction"] == "EU" and rows[0]["framework"] is None and rows[2]["document_id"] == "d"
    import hashlib

    assert rows[2]["id"] == "Doc.v1.txt_" + hashlib.sha256(b"/a/Doc.v1.txt").hexdigest()[:12] + "_p2_c2"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 60), st.integers(0, 70))
def test_closed_form(n, size, overlap):
    step = max(size - overlap, 1)
    assert (1 + math.ceil(max(n - size, 0) / step) if n else 0) == len(loop("x" * n, size, overlap))
