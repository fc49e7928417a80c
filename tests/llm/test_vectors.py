import numpy as np

from lexloom.llm import vector_knn as V

SCHEMA = "id string, embedding array<float>, cosine string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)


def brute(rows, k=5):
    ok = sorted({i: v for i, v in rows if i and v and len(v) == 16 and np.isfinite(v).all() and np.any(v)}.items())
    x = np.array([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids = [i for i, _ in ok]
    return {ids[a]: [(ids[b], s[a, b]) for b in np.argsort(-s[a], kind="stable")[:k]] for a in range(len(ids))}


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 4, 16))
    return [(f"v{i:05}", (rng.uniform(0.1, 9) * (centre[i % len(centre)] + 0.1 * rng.normal(size=16))).astype(np.float32).tolist()) for i in range(n)]


def test_beam_beats_greedy_and_decodes():
    rng = np.random.default_rng(0)
    x = V._unit(rng.normal(size=(600, 16)))
    q = V.AdditiveQuantiser.fit(x, rng)
    error = ((x - q.decode(q.encode(x))) ** 2).sum(1).mean()
    rest = x.copy()
    for book in q.books:
        rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book**2).sum(1), 1)]
    assert error <= (rest**2).sum(1).mean() and error < 0.3


def test_similar_pairs_are_found(spark):
    rows = clustered(2400)
    want = {(a, b) for a, near in brute(rows).items() for b, s in near if s >= 0.9}
    got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), k=5, least=0.9).where("cosine >= 0.9").collect()}
    assert len(want) > 1000 and got <= want and len(got) >= 0.97 * len(want)


def test_stated_queries_against_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:05}", rng.normal(size=16).astype(np.float32).tolist()) for i in range(2000)]
    want = brute(rows)
    asked = frame(spark, rows[::20]).selectExpr("id as query_id", "embedding")
    got = {}
    for r in V.search_vectors(frame(spark, rows), asked).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour"])
    assert len(got) == 100 and np.mean([len(got[q] & {b for b, _ in want[q]}) / 5 for q in got]) >= 0.9


def test_copies_and_unusable(spark):
    one, two = [1.0] + [0.0] * 15, [0.9, 0.1] + [0.0] * 14
    rows = [(f"c{i}", one) for i in range(9)] + [("d", two), ("d", two), ("n", None), ("z", [0.0] * 16), ("s", [1.0]), ("nan", [float("nan")] * 16), ("inf", [float("inf")] * 16), (None, one)]
    got = {}
    for r in V.similar_vectors(frame(spark, rows), k=5, dim=16).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["c0"] == ["c1", "c2", "c3", "c4", "c5"] and got["c8"] == ["c0", "c1", "c2", "c3", "c4"] and got["d"] == ["c0", "c1", "c2", "c3", "c4"] and len(got) == 10


def test_large_cells_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(f"v{i:03}", (base + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(150)]
    kw = {"k": 3, "dim": 16}
    whole = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), **kw).collect()}
    monkeypatch.setattr(V, "CELL_MAX", 40)
    parts = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), **kw).collect()}
    want = {(a, b) for a, near in brute(rows, 3).items() for b, _ in near}
    assert len(whole & want) >= 0.9 * len(want) and len(parts & want) >= len(whole & want)


def test_empty(spark):
    assert V.similar_vectors(frame(spark, [])).count() == 0
    assert V.search_vectors(frame(spark, []), frame(spark, []).selectExpr("id as query_id", "embedding")).count() == 0


def tight(n, seed=5):
    """A third of the rows in one narrow cluster of different vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=16)
    return [(f"v{i:05}", (base + 0.17 * rng.normal(size=16) if i % 3 == 0 else rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]


def test_tight_cluster_of_different_vectors_is_exact(spark, monkeypatch):
    rows = tight(1200)
    monkeypatch.setattr(V, "CELL_ROWS", 2000)  # one cell: what is lost is lost after the cells
    want = {(a, b) for a, near in brute(rows).items() for b, s in near if s >= 0.9}
    kw = {"k": 5, "dim": 16, "least": 0.9}
    assert len(want) > 1500
    for most in (V.CELL_MAX, 200):
        monkeypatch.setattr(V, "CELL_MAX", most)
        got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), **kw).collect()}
        assert len(got ^ want) <= 0.001 * len(want)  # but for ties by rounding


def test_codes_rule_out_only_what_is_proven():
    rng = np.random.default_rng(6)
    x = V._unit(np.array([v for _, v in tight(900) + clustered(900)]))
    quant = V.AdditiveQuantiser.fit(x, rng, rounds=1)
    code = quant.encode(x)
    norm = np.linalg.norm(quant.decode(code), axis=1)
    s = x @ x.T
    for least in (-2.0, 0.9):
        one, row, sim = V._best(quant, x, x, code, norm, 6, np.full(len(x), least))
        want = {(a, b) for a in range(len(x)) for b in np.argsort(-s[a], kind="stable")[:6] if s[a, b] >= least}
        assert len(want ^ set(zip(one.tolist(), row.tolist()))) <= 0.001 * len(want)  # but for ties by rounding


def test_all_neighbours_of_the_tables(spark):
    import os

    import pytest

    from lexloom.llm.queries import QUERIES

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    near = {}
    for r in QUERIES["p5_knn"](spark, data).collect():
        near.setdefault(r["id"], []).append(r["cosine"])
    v = {r["id"]: r["embedding"] for r in spark.read.parquet(f"{data}/chunk_vectors.parquet").collect() if r["id"] is not None and r["embedding"] is not None and len(r["embedding"]) == 64}
    ids = sorted(i for i, x in v.items() if None not in x and np.isfinite(x).all() and np.any(x))
    x = V._unit(np.array([v[i] for i in ids]))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    fifth = -np.sort(-s, 1)[:, 4]
    assert set(near) == set(ids)
    assert np.mean([sum(c >= t - 2e-6 for c in near[i]) / 5 for i, t in zip(ids, fifth)]) >= 0.9


def test_several_levels(spark, monkeypatch):
    """A tree of three levels, inner nodes fitted on their own rows: recall stays, no cell is large."""
    rows = clustered(3000)
    want = {(a, b) for a, near in brute(rows).items() for b, s in near if s >= 0.9}
    for name, value in {"FAN": 6, "CELL_ROWS": 30, "SAMPLE": 400}.items():
        monkeypatch.setattr(V, name, value)
    trees, fit_apart, apart = [], V._fit_apart, []
    monkeypatch.setattr(V.Tree, "close", lambda self, spill, close=V.Tree.close: trees.append(self) or close(self, spill))
    monkeypatch.setattr(V, "_fit_apart", lambda *a: apart.append(len(a[2])) or fit_apart(*a))
    got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), k=5, least=0.9).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    tree = trees[0]
    depth = np.zeros(len(tree.centres), int)
    for node in range(len(depth)):
        depth[tree.first[node] : tree.first[node] + tree.many[node]] = depth[node] + 1
    leaf = tree.many == 0
    assert depth.max() >= 2 and apart and (tree.rows[leaf] ** 2).sum() / tree.rows[leaf].sum() < 2 * V.CELL_ROWS
    asked = frame(spark, rows[::20]).selectExpr("id as query_id", "embedding")
    got = {}
    for r in V.search_vectors(frame(spark, rows), asked).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour"])
    exact = brute(rows)
    assert len(got) == 150 and np.mean([len(got[q] & {b for b, _ in exact[q]}) / 5 for q in got]) >= 0.9


def test_all_centroids_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(V, "MODEL_BYTES", 4 * 16 * 20)
    monkeypatch.setattr(V, "CELL_ROWS", 10)
    monkeypatch.setattr(V, "FAN", 8)
    monkeypatch.setattr(V, "CELL_MAX", 100)
    rows = clustered(1000)
    _, dim, tree, _ = V._fit(frame(spark, rows).selectExpr("id", "embedding as v"), None, 7, 3)
    assert dim == 16 and len(tree.centres) <= 20 and tree.blocks[tree.many == 0].max() > 1
    want = {(a, b) for a, near in brute(rows).items() for b, s in near if s >= 0.9}
    got = {(r["id"], r["neighbour"]) for r in V.similar_vectors(frame(spark, rows), k=5, least=0.9).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_vectors_of_another_length_change_nothing(spark):
    rows = clustered(200)
    odd = [*rows, ("long", [1.0] * 17), ("longer", [1.0] * 40), ("short", [1.0])]
    one, two = ({tuple(r) for r in V.similar_vectors(frame(spark, x)).select("id", "neighbour", "rank").collect()} for x in (rows, odd))
    assert one and one == two


def test_copies_unusable_and_blocks_in_search(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_MAX", 40)
    one = [1.0] + [0.0] * 15
    rows = [*clustered(150), *((f"c{i}", one) for i in range(9)), ("n", None), (None, one)]
    asked = spark.createDataFrame([("c3", one), ("c3", one), ("new", one), ("bad", [0.0] * 16), (None, one)], "query_id string, embedding array<float>")
    got = {}
    for r in V.search_vectors(frame(spark, rows), asked, k=4, probes=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour"])
    assert got == {"c3": ["c0", "c1", "c2", "c4"], "new": ["c0", "c1", "c2", "c3"]}
