"""Queries over tables whose keys are beyond 32 bits, as copies with shifted keys have them."""

import glob
import os

import pytest

from lexloom.plans.oracle import SQL
from lexloom.plans.registry import QUERIES
from lexloom.sources import store
from lexloom.streaming import ingest

SHIFT = 60_000_000_000
DOCUMENTS = "doc_id bigint, text string, source string, category string, jurisdiction string, document_id string"


def documents(spark, at, shift):
    """Documents of two files, as wide numbers follow narrow ones, with some that hold nothing."""
    texts = ["x" * 1000, "y" * 2000, " \n ", None, "z"]
    rows = [(i + 1 + (shift if i >= 3 else 0), texts[i % 5], ["One Two", "three", None][i % 3], None, "eu ", f"d{i}") for i in range(12)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def same_as_sql(name, got, d):
    con = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}/*.parquet'")
    want = con.sql(SQL[name])
    rows = sorted(map(repr, want.fetchall()))
    return bool(rows) and rows == sorted(repr(tuple(r)) for r in got.select(want.columns).collect())


@pytest.fixture
def both(spark, tmp_path):
    return [documents(spark, tmp_path / name, shift) for name, shift in (("narrow", 0), ("wide", SHIFT))]


def test_chunk_ids(spark, both):
    narrow, wide = ([r.asDict() for r in QUERIES["chunk_ids"](spark, d).orderBy("source", "chunk_ix").collect()] for d in both)
    assert len(narrow) == 12 and len({r["id"] for r in wide}) == 12
    for r in narrow:
        page = r["page"] + SHIFT * (r["page"] > 3)
        r |= {"page": page, "id": r["id"].replace(f"_p{r['page']}_", f"_p{page}_")}
    assert wide == narrow


def test_ingest_store(spark, both):
    for d in both:
        assert same_as_sql("ingest_store", QUERIES["ingest_store"](spark, d), d)


def test_a_store_with_narrow_pages_is_read(spark, tmp_path):
    """Stores written when page numbers had 32 bits."""
    at = str(tmp_path / "s")
    rows = [("a", 0, "t", "s", "p", 7, "c", ["SG"], None, None), ("b", 1, "t", "s", "p", None, "c", None, None, None)]
    spark.createDataFrame(rows, store.SCHEMA.replace("page bigint", "page int")).write.parquet(at)
    store.write_store(spark.createDataFrame([("c", 2, "t", "s", "p", SHIFT, "c", None, None, None)], store.SCHEMA), at)
    assert [r["page"] for r in store.read_store(spark, at).orderBy("ord").collect()] == [7, None, SHIFT]


def test_ingest_batch(spark, tmp_path):
    for shift in (0, SHIFT):
        d = f"{tmp_path}/{shift}"
        about = lambda path, page: ("s", path, page, "c", "eu", "d", None)
        chunks = [(shift + i, f"c{i}", t, about(p, i)) for i, (t, p) in enumerate([("x" * 1000, "/a"), ("y" * 2000, "/b.pdf"), ("z", "/a"), (" ", "/c.pdf"), (None, "/d.txt"), ("u", None), ("v", "/e")])]
        meta = "struct<source: string, source_path: string, page: int, category: string, jurisdiction: string, document_id: string, framework: string>"
        spark.createDataFrame(chunks, f"ord bigint, id string, text string, metadata {meta}").write.parquet(f"{d}/chunks.parquet")
        listed = [(shift + i, f"d{i}", "P1", ["EU"], None, p) for i, p in enumerate(["/a", "/b.pdf", "/c.pdf", "/d.txt", "/gone", " ", None, "/a"])]
        spark.createDataFrame(listed, "pos bigint, document_id string, tier string, jurisdiction array<string>, framework string, ingest_path string").write.parquet(f"{d}/inventory.parquet")
        got = QUERIES["ingest_batch"](spark, d)
        assert same_as_sql("ingest_batch", got, d)
        assert {r["document_id"]: (r["status"], r["chunks"]) for r in got.collect()} == {"d0": ("ok", 3), "d1": ("ok", 3), "d2": ("error", 0), "d3": ("ok", 0), "d4": ("missing_file", 0), "d7": ("ok", 3)}


def test_stream_ingest(spark, both):
    assert same_as_sql("stream_ingest", QUERIES["stream_ingest"](spark, both[0]), both[0])
    narrow, wide = (QUERIES["stream_ingest"](spark, d).orderBy("ord").collect() for d in both)
    assert [(r["text_md5"], r["document_id"], r["jurisdictions"], r["ord"] % (1 << 32)) for r in narrow] == [(r["text_md5"], r["document_id"], r["jurisdictions"], r["ord"] % (1 << 32)) for r in wide]
    assert len({r["ord"] for r in wide}) == len(wide) == 17 and {r["id"].split(".")[0] for r in wide} == {str(n + 1 + SHIFT * (n >= 3)) for n in range(12) if n % 5 not in (2, 3)}


def test_stream_of_wide_numbers(spark, tmp_path):
    """Places follow the store's, batch after batch, and a batch that is run again leaves nothing twice."""
    schema = "doc_no bigint, text string, path string, page bigint, category string, jurisdiction string, document_id string, framework string"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    row = lambda n, text, page=0: (n, text, f"/d/{n}.txt", page, None, "eu", None, None)
    for k, batch in enumerate([[row(7, "x" * 1000)], [row((1 << 63) - 1, "y"), row(2, "z"), row(SHIFT, "u"), row(SHIFT, "v", SHIFT)], [row(8, "w"), row(9, None)], []]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        if k == 3:
            (tmp_path / "ck" / "commits" / "2").unlink()
            (tmp_path / "ck" / "commits" / ".2.crc").unlink(missing_ok=True)
        ingest.start_ingest(ingest.document_stream(spark, src, schema), out, ck).awaitTermination()
    got = store.read_store(spark, out).orderBy("ord").collect()
    assert [(r["ord"] >> 32, r["ord"] % (1 << 32), r["text"][0], r["source"]) for r in got] == [
        (7, 0, "x", "7.txt"), (7, 1, "x", "7.txt"), (8, 0, "z", "2.txt"), (9, 0, "u", f"{SHIFT}.txt"), (9, 1, "v", f"{SHIFT}.txt"), (10, 0, "y", f"{(1 << 63) - 1}.txt"), (11, 0, "w", "8.txt")
    ]
