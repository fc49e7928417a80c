import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom import cli
from lexloom.engine import Engine
from lexloom.operators import dense
from lexloom.plans import ingest
from lexloom.sources import files, store

POLICY = "People may withdraw their consent at any time. Data sharing across borders needs safeguards.\n" * 12


def letters():
    class Letters:  # local, so it is sent to the tasks by value
        """Counts of letters: enough to test the interface with."""

        name, dim = "letters", 26

        def __call__(self, texts):
            return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)

    return Letters()


@pytest.fixture
def docs(tmp_path):
    at = tmp_path / "my docs"
    at.mkdir()
    (at / "a b ü+%41.txt").write_bytes(POLICY.encode().replace(b"\n", b"\r\n") + b"\xff")
    (at / "other.md").write_text("Freezer samples are kept in a biobank.")
    (at / "empty.txt").write_text(" \n ")
    return at


def test_files_to_store_and_back(spark, docs, tmp_path):
    at = ingest.Store(str(tmp_path / "store"))
    name = str(docs / "a b ü+%41.txt")
    assert [r["path"] for r in files.document_pages(spark, [name]).collect()] == [name]
    n = ingest.ingest_file(spark, name, at, jurisdiction=" sg ", document_id="d1", embedder=letters())
    assert n == 2 and ingest.ingest_file(spark, str(docs / "empty.txt"), at) == 0
    assert ingest.ingest_file(spark, str(docs / "other.md"), at, category="notes") == 1
    rows = store.read_store(spark, at.chunks).orderBy("ord").collect()
    assert [(r["ord"] >> 32, r["ord"] % (1 << 32)) for r in rows] == [(0, 0), (0, 1), (1, 0)]
    assert [(r["source"], r["category"], r["jurisdictions"], r["document_id"]) for r in rows[1:]] == [("a b ü+%41.txt", "a b ü+%41", ["SG"], "d1"), ("other.md", "notes", None, None)]
    assert rows[0]["source_path"] == name and "\r" not in rows[0]["text"] and rows[0]["id"].startswith("a b ü+%41.txt_")
    v = store.read_vectors(spark, at.vectors, "letters").orderBy("ord").collect()
    assert [r["id"] for r in v] == [r["id"] for r in rows[:2]] and abs(np.linalg.norm(v[0]["embedding"]) - 1) < 1e-6
    with pytest.raises(FileNotFoundError):
        ingest.ingest_file(spark, str(docs / "none.txt"), at)
    assert ingest.ingest_file(spark, str(docs / "other.md"), at, reset=True) == 1 and store.read_store(spark, at.chunks).first()["ord"] == 0


def test_a_pdf_without_text_is_an_error(spark, docs, tmp_path, monkeypatch):
    (docs / "scan.PDF").write_bytes(b"%PDF")
    monkeypatch.setattr(files, "pdf_pages", lambda spark, paths: spark.createDataFrame([(p, 1, "") for p in paths], files.PAGES))
    at = ingest.Store(str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no text"):
        ingest.ingest_file(spark, str(docs / "scan.PDF"), at)
    pages = files.document_pages(spark, [str(docs / "scan.PDF"), str(docs / "other.md")])
    assert pages.count() == 2
    inv = spark.createDataFrame([(i, d, None, "P1", [], None, None, None, str(docs / f), None, None) for i, (d, f) in enumerate([("b", "scan.PDF"), ("a", "other.md"), ("a2", "other.md"), ("c", "none")])], files.INVENTORY)
    got = {r["document_id"]: (r["status"], r["chunks"]) for r in ingest.ingest_batch(inv, pages, at).collect()}
    assert got == {"b": ("error", 0), "a": ("ok", 1), "a2": ("ok", 1), "c": ("missing_file", 0)}
    row = store.read_store(spark, at.chunks).collect()
    assert len(row) == 1 and row[0]["document_id"] == row[0]["category"] == "a"


def test_inventory_is_ingested_and_dated(spark, docs, tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "inventory.yaml"
    p.write_text(yaml.safe_dump({"version": "3", "documents": [
        {"document_id": "late", "tier": "P2", "jurisdiction": ["EU", "INTL"], "ingest_path": "my docs/other.md", "ingested_at": None, "contact": "x"},
        {"document_id": "gone", "tier": "P0", "ingest_path": "my docs/none.txt"}, {"document_id": "blank", "tier": "P0", "ingest_path": " "},
        {"document_id": "first", "tier": "P1", "jurisdiction": ["INTL", "sg"], "ingest_path": "my docs/a b ü+%41.txt", "ingested_at": ""}, {"document_id": "old", "tier": "P1", "ingest_path": "my docs/other.md", "ingested_at": "2020"},
    ]}))
    at = ingest.Store(str(tmp_path / "store"))
    before = p.read_text()
    done = ingest.ingest_inventory(spark, str(p), at, dry_run=True)
    assert {r["status"] for r in done["results"]} == {"dry_run", "missing_file"} and p.read_text() == before and store.read_store(spark, at.chunks).count() == 0
    done = ingest.ingest_inventory(spark, str(p), at, embedder=letters())
    assert (done["ingested"], done["missing_file"], done["errors"]) == (2, 1, 0)
    rows = store.read_store(spark, at.chunks).orderBy("ord").collect()
    assert [(r["document_id"], r["ord"] >> 32, r["jurisdictions"]) for r in rows] == [("first", 1, ["SG"]), ("first", 1, ["SG"]), ("late", 2, ["EU"])]
    data = yaml.safe_load(p.read_text())
    assert data["version"] == "3" and data["updated"] and data["documents"][0]["contact"] == "x" and data["documents"][0]["ingested_at"] and data["documents"][4]["ingested_at"] == "2020" and "ingested_at" not in data["documents"][1]
    assert ingest.ingest_inventory(spark, str(p), at)["ingested"] == 0
    assert ingest.ingest_inventory(spark, str(p), at, reset=True)["ingested"] == 3


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, " "), (4, "12")], "id bigint, text string")
    got = {r["id"]: r for r in dense.embed(rows, letters(), ["id"]).collect()}
    assert abs(got[1]["embedding"][0] - 0.5**0.5) < 1e-6 and got[2]["embedding"] is None and got[3]["embedding"] is None and set(got[4]["embedding"]) == {0.0} and got[1]["embedder"] == "letters"


def test_engine_from_ingest_to_report(spark, docs, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), letters(), {"SG": "Singapore"})
    q = spark.createDataFrame([(1, "withdraw consent"), (2, " ")], "query_id bigint, text string")
    assert not e.ready() and e.retrieve(q).count() == 0
    texts = spark.createDataFrame([(7, "A biobank study: you may withdraw.")], "report_id bigint, text string")
    assert e.check(texts).first()["made_by"] == "empty store"
    e.ingest(str(docs / "a b ü+%41.txt"), jurisdiction="SG")
    e.ingest(str(docs / "other.md"))
    assert e.ready() and [r[0] for r in e.jurisdictions().collect()] == ["SG"] and e.browse("sg").count() == 2
    hits = e.retrieve(q).collect()
    assert {r["query_id"] for r in hits} == {1} and len(hits) == 3
    assert {r["source"] for r in e.retrieve(q, jurisdictions=["sg"]).collect()} == {"a b ü+%41.txt"}
    r = e.check(texts).first()
    assert r["made_by"] == "keywords" and r["study_type"] == "biobank" and r["grounding_ok"]
    good = json.dumps({"status": "Compliant", "recommendations": [{"text": "say how to withdraw consent", "evidence_chunk_ids": [hits[0]["id"]]}]})
    r = e.check(texts, spark.createDataFrame([(7, 1, good)], "report_id bigint, attempt int, raw string")).first()
    assert r["made_by"] == "model" and r["status"] == "Compliant" and r["grounding_ok"]
    with pytest.raises(ValueError):
        e.check(spark.createDataFrame([(1, " ")], "report_id bigint, text string"))


def test_command_line(spark, docs, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))

    def run(*args):
        out = io.StringIO()
        code = cli.main(list(args), e, out)
        return code, json.loads(out.getvalue() or "null")

    assert run("status")[1]["ready"] is False
    assert run("ingest", "--path", str(docs / "none.txt"))[0] == 1
    code, got = run("ingest", "--path", str(docs / "a b ü+%41.txt"), "--jurisdiction", "sg")
    assert code == 0 and got["chunks"] == 2 and "ü" in got["path"]
    (tmp_path / "q.txt").write_text("consent\n\n zebra \n")
    (tmp_path / "t.txt").write_text("You may withdraw.")
    code, got = run("eval", "--path", str(docs / "other.md"), "--queries", str(tmp_path / "q.txt"), "--text", str(tmp_path / "t.txt"), "--top-k", "2")
    assert code == 0 and [x["query"] for x in got["retrieval"]] == ["consent", "zebra"] and got["retrieval"][0]["hit_count"] == 2 and got["report"]["made_by"] == "keywords"
    (tmp_path / "a.json").write_text('{"status": "Compliant"}')
    code, got = run("check", "--text", str(tmp_path / "t.txt"), "--answer", str(tmp_path / "a.json"), "--jurisdiction", "SG")
    assert code == 0 and got["status"] == "Compliant" and got["grounding_attempts"] == 1
    assert run("status")[1]["ready"] is True
    yaml = pytest.importorskip("yaml")
    (tmp_path / "i.yaml").write_text(yaml.safe_dump({"documents": [{"document_id": "d", "ingest_path": str(docs / "other.md")}]}))
    code, got = run("ingest-inventory", "--inventory", str(tmp_path / "i.yaml"), "--reset")
    assert code == 0 and got["ingested"] == 1 and got["results"][0]["status"] == "ok"


def test_json_rows(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "ü", None)], "a bigint, b string, c string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":"ü","c":null}'
    assert json.loads(files.json_text({"x": spark.createDataFrame([(1,)], "a int").first()}))["x"] in ({"a": 1}, [1])
