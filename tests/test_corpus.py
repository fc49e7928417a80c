import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, inventory
from lexloom.session import numbered, shared_dir
from lexloom.sources import files, store
from lexloom.streaming import ingest

INV = files.INVENTORY


def inv(spark, *rows):
    base = dict.fromkeys(c.split()[0] for c in INV.split(", "))
    return spark.createDataFrame([tuple({**base, "pos": i, **r}.values()) for i, r in enumerate(rows)], INV)


def test_primary_jurisdiction(spark):
    rows = inv(spark, {"jurisdiction": ["ORG", "INTL"]}, {"jurisdiction": ["INTL"]}, {"jurisdiction": []}, {"jurisdiction": None}, {"jurisdiction": ["intl", " ", "eu "]})
    assert [r[0] for r in rows.orderBy("pos").select(inventory.primary_jurisdiction(F.col("jurisdiction"))).collect()] == ["ORG", "INTL", None, None, "EU"]


def test_option_labels(spark):
    names = {"SG": "Singapore", "AA": "first"}
    df = spark.createDataFrame([(" sg",), ("XX",), (None,)], "c string")
    assert [r[0] for r in df.select(inventory.option_label(F.col("c"), names)).collect()] == ["SG — Singapore", "XX", None]
    assert [r[0] for r in df.select(inventory.option_label(F.col("c"), {})).collect()] == ["SG", "XX", None]
    chosen = spark.createDataFrame([(["AA — first", "SG — Singapore", "zz ", "sg", None],)], "c array<string>")
    assert chosen.select(inventory.codes_of_labels(F.col("c"), names)).first()[0] == ["AA", "SG", "ZZ"]


def test_selection_and_results(spark):
    rows = inv(
        spark, {"document_id": "b", "tier": "p1", "ingest_path": "/x"}, {"document_id": "a", "tier": None, "ingest_path": "/y"}, {"document_id": "c", "tier": "P0", "ingest_path": " "}, {"document_id": "d", "tier": "P0", "ingest_path": "/z", "ingested_at": "2025"}
    )
    s = inventory.select_for_ingest(rows)
    assert [(r["document_id"], r["tier_rank"]) for r in s.orderBy("tier_rank", "document_id").collect()] == [("b", 1), ("a", 9)]
    assert inventory.select_for_ingest(rows, reset=True).count() == 3
    assert [r["document_id"] for r in inventory.select_for_ingest(rows, tier="P1").collect()] == ["b"]
    res = inventory.ingest_results(s, spark.createDataFrame([("/x", 4)], "path string, chunks bigint"), spark.createDataFrame([("/x",)], "path string"))
    assert {(r["document_id"], r["status"], r["chunks"]) for r in res.collect()} == {("b", "ok", 4), ("a", "missing_file", 0)}
    assert tuple(inventory.ingest_summary(res).first()) == (1, 1, 0)
    assert {r["status"] for r in inventory.ingest_results(s, spark.createDataFrame([], "path string, chunks bigint"), spark.createDataFrame([("/x",)], "path string"), dry_run=True).collect()} == {"dry_run", "missing_file"}


def test_listing(spark):
    rows = inv(spark, {"document_id": "a", "jurisdiction": ["eu"], "title": "", "source_url": " u "}, {"tier": "", "jurisdiction": None})
    r = inventory.listing(rows).orderBy("pos").collect()
    assert (r[0]["title"], r[0]["source_url"], r[1]["title"], r[1]["tier"], r[1]["source_url"]) == ("a", "u", "Untitled", "P2", None)
    assert inventory.listing(rows, "EU").count() == 1 and inventory.listing(rows, "nowhere").count() == 0 and inventory.listing(rows, "all").count() == 2


def chunks(spark):
    return spark.createDataFrame([(f"c{i}", i, "t", "cat", 0, [["HK"], ["hk ", "EU"], None, []][i % 4], "doc" if i else None) for i in range(8)], "id string, ord bigint, text string, category string, page int, jurisdictions array<string>, document_id string").selectExpr("*", "'s' as source", "'p' as source_path", "cast(null as string) as framework")


def test_browse_and_links(spark):
    r = inventory.browse(chunks(spark), "hk", ["HK", "EU"], 3).collect()
    assert [x["id"] for x in r] == ["c0", "c1", "c4"] and r[0]["total"] == 4
    for bad in (("XX", ["HK"], 3), ("HK", ["HK"], 0), ("HK", ["HK"], 81)):
        with pytest.raises(ValueError):
            inventory.browse(chunks(spark), *bad)
    assert {x[0] for x in inventory.distinct_jurisdictions(chunks(spark)).collect()} == {"HK", "EU"}
    links = inventory.with_source_url(chunks(spark), inv(spark, {"document_id": "doc", "source_url": "old"}, {"document_id": "doc", "source_url": "new"}, {"document_id": "cat", "source_url": "c"}, {"document_id": "doc", "source_url": " "}))
    assert {x["id"]: x["source_url"] for x in links.where("ord < 2").collect()} == {"c0": "c", "c1": "new"}


def test_repeated_ids(spark):
    df = spark.createDataFrame([("a", 3, "new"), ("a", 1, "old"), ("b", 2, None)], "id string, ord bigint, text string")
    assert {tuple(r) for r in store.one_per_id(df).collect()} == {("a", 1, "new"), ("b", 2, None)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\xff")
    (tmp_path / "q.txt").write_text(" one \n\n two\n")
    r = files.text_pages(spark, str(tmp_path / "a.txt")).first()
    assert (r["page"], r["text"]) == (0, "x\ny\nz�")
    assert sorted(x["text"] for x in files.query_lines(spark, str(tmp_path / "q.txt")).collect()) == ["one", "two"]
    assert files.query_lines(spark).count() == 5
    assert files.document_pages(spark, []).count() == 0
    assert files.resolve_path("/abs", "m.yaml") == "/abs"
    (tmp_path / "docs").mkdir()
    assert files.resolve_path("a.txt", str(tmp_path / "docs" / "m.yaml")) == str(tmp_path / "a.txt")
    assert files.resolve_path("none.txt", str(tmp_path / "docs" / "m.yaml")) == str(tmp_path / "none.txt")


def test_inventory_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "m.yaml"
    p.write_text("")
    assert files.read_inventory(spark, str(p)).count() == 0
    p.write_text(yaml.safe_dump({"documents": [{"document_id": "d", "jurisdiction": ["EU"], "ingested_at": None}]}))
    rows = files.read_inventory(spark, str(p))
    files.write_inventory(rows, str(p))
    assert files.read_inventory(spark, str(p)).first()["jurisdiction"] == ["EU"]
    p.write_text(yaml.safe_dump({"version": "7", "updated": "u", "owner": "me", "documents": [{"document_id": "d", "extra": [1], "ingested_at": None}, {"document_id": "e"}]}))
    files.write_inventory(files.read_inventory(spark, str(p)).withColumn("ingested_at", F.when(F.col("pos") == 0, "now")), str(p), "later")
    assert yaml.safe_load(p.read_text()) == {"version": "7", "updated": "later", "owner": "me", "documents": [{"document_id": "d", "extra": [1], "ingested_at": "now"}, {"document_id": "e"}]}
    for bad in ("[1]", "documents: 3"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            files.read_inventory(spark, str(p))


def test_store_round_trip(spark, tmp_path):
    at = str(tmp_path / "s")
    assert store.read_store(spark, at).count() == 0
    row = spark.createDataFrame([("a", 1, "t", "s", "p", 0, "c", ["EU"], None, None)], store.SCHEMA)
    store.write_store(row, at)
    store.write_store(row, at)
    assert store.read_store(spark, at).count() == 2
    store.write_store(row, at, reset=True)
    assert store.read_store(spark, at).count() == 1
    v = str(tmp_path / "v")
    store.write_vectors(spark.createDataFrame([("a", 0, [1.0], "m1"), ("a", 0, [1.0], "m1")], store.VECTOR_SCHEMA), v)
    assert store.read_vectors(spark, v, "m1").count() == 1
    with pytest.raises(ValueError):
        store.read_vectors(spark, v, "m2")
    for bad in (row.drop("ord"), row.withColumn("jurisdictions", F.lit("EU")), row.withColumn("page", F.lit("1"))):
        with pytest.raises(ValueError, match="chunk rows"):
            store.write_store(bad, at)
    assert store.read_store(spark, at).count() == 1 and store.next_place(spark, at) == 1 and store.next_place(spark, str(tmp_path / "none")) == 0


def test_stream(spark, tmp_path):
    schema = "doc_no bigint, text string, path string, page int, category string, jurisdiction string, document_id string, framework string"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    row = lambda n, text: (n, text, f"/d/{n}.txt", 0, None, "eu", None, None)
    store.write_store(spark.createDataFrame([("old", 0, "t", "s", "p", 0, "c", ["SG"], None, None)], store.SCHEMA), out)
    spark.createDataFrame([row(1, "x" * 1000)], schema).write.parquet(src)
    for more in (None, [row(2, "y"), row(3, None)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(src)
        ingest.start_ingest(ingest.document_stream(spark, src, schema), out, ck).awaitTermination()
    got = store.read_store(spark, out).orderBy("ord").collect()
    assert [(r["ord"] >> 32, r["ord"] % (1 << 32), r["category"], r["jurisdictions"]) for r in got] == [(0, 0, "c", ["SG"]), (1, 0, "1", ["EU"]), (1, 1, "1", ["EU"]), (2, 0, "2", ["EU"])]


def test_numbered(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id * 7919 % 5000 as int) as k")
    got = numbered(rows, ["k"]).collect()
    assert len(got) == 5000 and all(r["pos"] == r["k"] for r in got)
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    monkeypatch.setattr(Cluster.sparkContext, "master", "local[2]")
    assert shared_dir(Cluster).startswith("file:")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (5, 5), (None, 4), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (11, 10)] + [(100, 200 + i) for i in range(50)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got[3] == 1 and got[11] == 10 and got[5] == 5 and got[25] == 20 and 4 not in got
    assert all(got[200 + i] == 100 for i in range(50)) and all(got[300 + i] == 300 for i in range(41))
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
