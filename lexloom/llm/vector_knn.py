"""The most similar vectors of every vector: additive quantisation with exact reranking.

Fitted on bounded samples: a tree of coarse cells and ``BOOKS`` full-dimensional codebooks, started by
residual k-means and refined by least squares over beam-search encodings. The tree grows by spherical k-means
until no cell is expected to hold more than twice ``CELL_ROWS`` different vectors: the first level, and nodes
of which it holds enough, are fitted on ``SAMPLE`` rows at the driver, all other nodes each in a task on
``2 * PER_CELL`` rows a child drawn from its own rows. All centroids together stay within ``MODEL_BYTES``.

Every row is encoded by beam search; its code, the norm of what the code stands for, and its vector go to its
``SPILL`` best cells, which a beam search down the tree finds. Within a
cell each row's lookup table (its product with every codeword) scores all other rows by their codes and
stored norms. The exact cosines of the best ``SHORTLIST`` set a bar, and every row that its code does not
prove to be under the bar is ranked again by its exact cosine, so within a cell no neighbour is lost. The
best ``k`` over all cells are a row's neighbours.

Equal vectors form one class that enters a cell once, so any number of copies costs one row; the copies
of a class are each other's neighbours at cosine 1, in the order of their ids. A cell that can't be divided
and is expected to hold more than ``CELL_MAX`` classes is sent as blocks from the start, and each pair of
blocks is compared in a task of its own: no task holds the cell, and no neighbour is lost.

Edge cases: null, short, too long, non-finite and all-zero vectors never count; lengths don't matter; rows that
repeat an id are one (of different vectors of an id one counts); equal cosines go to the smaller id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import staged

SAMPLE = 20_000
BOOKS, WORDS, BEAM = 8, 64, 4
#: Different vectors that a cell should hold; a node with more than twice as many is divided.
CELL_ROWS, CELL_MAX = 500, 16_384
#: Most children of a node, and rows of the sample that a child is fitted on.
FAN, PER_CELL = 512, 16
#: Bound on all centroids, which every task gets: 250,000 cells of 64 values.
MODEL_BYTES = 64 << 20
#: Nodes of a level that a row's way down the tree may pass, and cells that a query is compared with.
TREE_BEAM, PROBES = 6, 12
SPILL = 3
#: Rows by code whose exact cosines set the bar that all others are held against; it limits no result.
SHORTLIST = 32
#: Share of pairs left open by the codes from which computing all is quicker.
DENSE = 0.1


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1)), 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=k)
        full = size > 0
        c[full] = total[full] / size[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class AdditiveQuantiser:
    """``BOOKS`` codebooks whose chosen words, one of each, add up to a vector."""

    def __init__(self, books: np.ndarray):
        self.books = books  # (BOOKS, WORDS, d)
        flat = books.reshape(-1, books.shape[2])
        self.flat, self.gram = flat, flat @ flat.T

    @classmethod
    def fit(cls, x: np.ndarray, rng: np.random.Generator, rounds: int = 3) -> AdditiveQuantiser:
        rest, books = x.copy(), []
        for _ in range(BOOKS):
            c = _kmeans(rest, WORDS, 8, rng)
            c = np.concatenate((c, np.zeros((WORDS - len(c), x.shape[1]), np.float32)))
            books.append(c)
            rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c * c).sum(1), 1)]
        own = cls(np.stack(books))
        for _ in range(rounds):
            codes = own.encode(x)
            hot = np.zeros((len(x), BOOKS * WORDS), np.float32)
            hot[np.arange(len(x))[:, None], codes + np.arange(BOOKS) * WORDS] = 1
            best = np.linalg.solve(hot.T @ hot + 0.1 * np.eye(BOOKS * WORDS, dtype=np.float32), hot.T @ x + 0.1 * own.flat)
            own = cls(best.astype(np.float32).reshape(BOOKS, WORDS, -1))
        return own

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: at each book the ``BEAM`` best of all extensions are kept."""
        out = np.empty((len(x), BOOKS), np.uint8)
        norms = np.diag(self.gram)
        for s in range(0, len(x), 2000):
            part = x[s : s + 2000]
            n = len(part)
            dot = part @ self.flat.T
            rows = np.arange(n)[:, None]
            codes = np.zeros((n, 1, BOOKS), np.int64)
            error = np.zeros((n, 1), np.float32)
            for m in range(BOOKS):
                own = slice(m * WORDS, (m + 1) * WORDS)
                ext = error[:, :, None] + (norms[own] - 2 * dot[:, own])[:, None, :]
                for p in range(m):
                    ext += 2 * self.gram[codes[:, :, p] + p * WORDS, own]
                flat = ext.reshape(n, -1)
                width = min(BEAM, flat.shape[1])
                top = np.argpartition(flat, width - 1, axis=1)[:, :width]
                error = flat[rows, top]
                codes = codes[rows, top // WORDS]
                codes[:, :, m] = top % WORDS
            out[s : s + n] = codes[np.arange(n), np.argmin(error, 1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[codes.astype(np.int64) + np.arange(BOOKS) * WORDS].sum(1)


class Tree:
    """Coarse cells: a tree of spherical k-means centroids. A leaf is a cell.

    ``centres`` holds all nodes but the root; the children of a node follow each other from ``first`` on,
    ``many`` of them (0: a leaf). ``rows`` is the number of different vectors expected in a node.
    """

    def __init__(self, centres: np.ndarray, rows: np.ndarray):
        self.centres, self.rows = centres, rows
        self.top, self.first, self.many = len(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        self.closed = np.zeros(len(centres), bool)  # not to be divided again

    def too_large(self) -> np.ndarray:
        """Leaves to be divided, and among how many children, within the bound on all cells."""
        node = np.flatnonzero((self.many == 0) & ~self.closed & (self.rows > 2 * CELL_ROWS))
        want = np.minimum(FAN, np.ceil(self.rows[node] / CELL_ROWS)).astype(np.int64)
        free = MODEL_BYTES // (4 * self.centres.shape[1]) - len(self.centres)
        if want.sum() > free:
            want = want * max(0, free) // want.sum()
        return np.stack((node, want), 1)[want > 1]

    def divide(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Give leaves ``(node, centres, shares)`` their children; one that can't be parted is left as it is."""
        self.closed[[node for node, *_ in parts]] = True
        parts = [p for p in parts if len(p[1]) > 1 and p[2].max() <= 0.95]
        if not parts:
            return
        node, many = np.array([p[0] for p in parts]), np.array([len(p[1]) for p in parts])
        self.first[node], self.many[node] = len(self.centres) + np.cumsum(many) - many, many
        rows = np.concatenate([share * self.rows[n] for n, _, share in parts])
        self.centres, self.rows = np.concatenate([self.centres, *(c for _, c, _ in parts)]), np.concatenate((self.rows, rows))
        for name in ("first", "many", "closed"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate((old, np.zeros(len(rows), old.dtype))))

    def _scores(self, x: np.ndarray, one: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, child and its product with the row, for all children of the given (row, inner node) pairs."""
        out = []
        for k in np.unique(self.many[node]).tolist():
            mine = self.many[node] == k
            r, at = one[mine], self.first[node[mine]]
            if k > 16:  # few nodes of many children: one matrix product each
                by = np.argsort(at, kind="stable")
                r, at = r[by], at[by]
                for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(at)) + 1):
                    child = at[part[0]] + np.arange(k)
                    out.append((np.repeat(r[part], k), np.tile(child, len(part)), (x[r[part]] @ self.centres[child].T).ravel()))
            else:
                for s in range(0, len(r), 20_000):
                    child = at[s : s + 20_000, None] + np.arange(k)
                    own = np.einsum("pd,pkd->pk", x[r[s : s + 20_000]], self.centres[child])
                    out.append((np.repeat(r[s : s + 20_000], k), child.ravel(), own.ravel()))
        return tuple(np.concatenate(c) for c in zip(*out))

    def assign(self, x: np.ndarray, spill: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ``(row, cell)``: the ``spill`` best cells of each row, best first, by a beam search down the tree."""
        near = x @ self.centres[: self.top].T
        width = min(max(beam, spill), self.top)
        node = np.argpartition(-near, width - 1, axis=1)[:, :width].astype(np.int64)
        score = np.take_along_axis(near, node, 1).ravel()
        one, node = np.repeat(np.arange(len(x)), width), node.ravel()
        while (inner := self.many[node] > 0).any():
            r, child, own = self._scores(x, one[inner], node[inner])
            one, node, score = np.concatenate((one[~inner], r)), np.concatenate((node[~inner], child)), np.concatenate((score[~inner], own))
            one, node, score = _first(one, node, score, max(beam, spill), 9)
        one, node, _ = _first(one, node, score, spill, 9)
        return one, node

    def close(self, spill: int) -> Tree:
        """Mark the cells that are too large for one task: so many blocks are compared with each other."""
        self.blocks = np.maximum(1, np.ceil(self.rows * spill / CELL_MAX)).astype(np.int64)
        return self


def _children(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a node's sample, and the share of the sample at each."""
    c = _kmeans(x, k, 8, np.random.default_rng(seed), spherical=True)
    size = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c))
    return c[size > 0], size[size > 0] / len(x)


def _best(quant: AdditiveQuantiser, q, vec, code, norm, k: int, floor: np.ndarray, places: int = 9):
    """Flat ``(query, row, cosine)``: the ``k`` rows of largest exact cosine of each query, ties to the
    earlier row; rows below the query's ``floor`` need not come.

    A row is left out by its code only where that is proven: with the angles s to what the code stands
    for and r between that and the row, the cosine is at most cos(s - r). Where this leaves more than
    ``DENSE`` of the pairs open, all are computed.
    """
    place = code.astype(np.int64) + np.arange(BOOKS) * WORDS
    near = np.clip(np.einsum("nd,nd->n", vec, quant.decode(code)) / norm, -1, 1).astype(np.float32)
    far = np.sqrt(1 - near * near)
    short = min(max(SHORTLIST, 4 * k), len(vec))
    got, dense, s = [], len(vec) <= short, 0
    step = max(1, 400_000 // len(vec))
    while s < len(q):
        e = s + (step if s else min(step, 32))  # a few first, to see whether the codes rule out enough
        part, least = q[s:e], floor[s:e].astype(np.float32)
        if not dense:
            lut = part @ quant.flat.T
            score = lut[:, place[:, 0]]
            for m in range(1, BOOKS):
                score += lut[:, place[:, m]]
            score = np.clip(score / norm, -1, 1)
            top = np.argpartition(-score, short - 1, axis=1)[:, :short]
            exact = np.einsum("qd,qsd->qs", part, vec[top])
            least = np.maximum(least, -np.partition(-exact, k - 1, axis=1)[:, k - 1])
            most = np.where(score >= near, 1, score * near + np.sqrt(1 - score * score) * far)
            one, row = np.nonzero(most >= least[:, None] - 1e-5)
            dense = len(one) > DENSE * score.size
        if dense:
            exact = part @ vec.T
            if len(vec) > k:
                least = np.maximum(least, -np.partition(-exact, k - 1, axis=1)[:, k - 1])
            one, row = np.nonzero(exact >= least[:, None] - 1e-6)
            sim = exact[one, row]
        else:
            sim = np.concatenate([np.einsum("pd,pd->p", part[one[i : i + 100_000]], vec[row[i : i + 100_000]]) for i in range(0, max(1, len(one)), 100_000)])
        got.append(_first(one, row, sim, k, places))
        got[-1][0] += s
        s = e
    return [np.concatenate(c) for c in zip(*got)]


def _first(one: np.ndarray, order: np.ndarray, sim: np.ndarray, k: int, places: int) -> list[np.ndarray]:
    """Of each query in ``one`` the first ``k`` by cosine to so many ``places``, then ``order``."""
    by = np.lexsort((order, -np.round(sim.astype(np.float64), places), one))
    one, order, sim = one[by], order[by], sim[by]
    start = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))[: len(one)])
    ok = np.arange(len(one)) - np.repeat(start, np.diff(np.append(start, len(one)))) < k
    return [one[ok], order[ok], sim[ok]]


def _neighbours(quant: AdditiveQuantiser, q_key, q_vec, key, vec, code, norm, k: int, least: float | None):
    """Best ``k`` rows of (key, vec, code, norm) for each query, exact cosines, itself left out."""
    if len(key) < 2:
        return None
    one, row, sim = _best(quant, q_vec, vec, code, norm, k + 1, np.full(len(q_key), -2 if least is None else least - 1e-6))  # one more, as it may be itself
    other = q_key[one] != key[row]
    one, row, sim = _first(one[other], row[other], sim[other], k, 9)
    ok = sim > (-2 if least is None else least - 1e-6)
    return [q_key[one[ok]], key[row[ok]], sim[ok]]


ROW = "part bigint, side int, key bigint, vec binary, code binary, norm float"
PAIRS = "a bigint, b bigint, cosine double"


def _arrays(batch: pa.RecordBatch, dim: int):
    """Keys, vectors, codes and norms of rows, each key once."""
    key, first = np.unique(batch.column("key").to_numpy(), return_index=True)
    vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, dim)
    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, BOOKS)
    return [key, vec[first], code[first], batch.column("norm").to_numpy()[first]]


def _out(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.float64))], names=["a", "b", "cosine"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a stream sorted by part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        if held and len(part) and part[0] != held[-1].column("part")[0].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if e > s:
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())


def _parts(cell: np.ndarray, key: np.ndarray, blocks: np.ndarray, asked: bool | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ``(place, part, side)``: where the (cell, key) pairs at each place must go.

    A cell of one block is one part. Of a cell of n blocks, a row to be compared with all others (``asked``
    None) goes to the n pairs of blocks that hold its own; of stated queries (True) each goes to all blocks,
    of rows to be searched (False) each to its own block.
    """
    n = blocks[cell]
    block = (key.view(np.uint64) >> np.uint64(20)).astype(np.int64) % n
    times = np.ones_like(n) if asked is False else n
    at = np.repeat(np.arange(len(cell)), times)
    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    own = block[at]
    if asked is None:
        left, right, side = np.minimum(own, other), np.maximum(own, other), (own > other).astype(np.int32)
    else:
        left = right = own if asked is False else other
        side = np.full(len(at), 0 if asked else 1, np.int32)
    return at, (cell[at] << np.int64(40)) | (left << np.int64(20)) | right, side


SOUND = "id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(v, x -> x <> 0)"


def _fit(rows: DataFrame, dim: int | None, seed: int, spill: int):
    """Usable rows ``(key, id, v)``, their length, and what is fitted on samples of them."""
    sound = rows.where(SOUND).withColumn("key", F.xxhash64("v"))
    if dim is not None:
        sound = sound.where(F.size("v") == dim)
    most = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows"), F.approx_count_distinct("key").alias("n")).orderBy(F.desc("rows"), F.desc("d")).first()
    dim, n = (most["d"], max(1, most["n"])) if most else (dim or 1, 1)
    usable = sound.where(F.size("v") == dim).select("key", "id", "v")

    def drawn(share: float, salt: int) -> DataFrame:
        """Different vectors with a hash in the first ``share`` of all, with their place in hash order."""
        place = F.pmod(F.xxhash64(F.lit(seed + salt), "key"), F.lit(1 << 30))
        return usable.withColumn("place", place).where(F.col("place") < int(min(1.0, share) * (1 << 30))).select("place", "key", "v").dropDuplicates(["key"])

    got = drawn(1.2 * SAMPLE / n, 0).orderBy("place", "key").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    rng = np.random.default_rng(seed)
    sample = _unit(np.array(got or [[1.0] * dim], np.float32).reshape(-1, dim))
    centres, share = _children(sample, min(FAN, max(1, round(n / CELL_ROWS))), seed)
    tree = Tree(centres, share * n)
    level = 0
    while len(todo := tree.too_large()):
        level += 1
        one, node = tree.assign(sample, 1, 1)
        one = one[np.argsort(node, kind="stable")]
        node = np.sort(node)
        parts, thin = [], {}
        for at, k in todo.tolist():
            mine = sample[one[np.searchsorted(node, at) : np.searchsorted(node, at, "right")]]
            if len(mine) >= PER_CELL * k:
                parts.append((at, *_children(mine, k, seed + level)))
            else:
                thin[at] = k
        if thin:
            parts += _fit_apart(drawn(2 * PER_CELL / CELL_ROWS, level), tree, thin, dim, seed + level)
            tree.closed[list(thin)] = True
        tree.divide(parts)
    return usable, dim, tree.close(spill), AdditiveQuantiser.fit(sample, rng)


def _fit_apart(rows: DataFrame, tree: Tree, wanted: dict[int, int], dim: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Children of the nodes ``wanted`` (node: how many), each fitted in a task of its own on at most
    ``2 * PER_CELL`` rows a child. What comes back is centroids, within ``MODEL_BYTES`` together."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((tree, wanted))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, wanted = held.value
        asked = np.zeros(len(tree.centres), bool)
        asked[list(wanted)] = True
        for whole in batches:
            for s in range(0, whole.num_rows, 4000):
                batch = whole.slice(s, 4000)
                vec = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                one, node = tree.assign(vec, 1, 1)
                ok = asked[node]
                one, node = one[ok], node[ok]
                most = np.array([2 * PER_CELL * wanted[x] for x in node.tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(most), batch.column("place").take(pa.array(one)), _fixed(vec[one], 4 * dim)], names=["node", "most", "place", "vec"])

    def fit(pdf):
        import pandas as pd

        node = int(pdf["node"].iloc[0])
        x = np.frombuffer(b"".join(pdf.sort_values(["place", "vec"])["vec"]), np.float32).reshape(-1, dim)
        c, share = _children(x, min(held.value[1][node], max(1, len(x) // 4)), seed)
        return pd.DataFrame({"node": node, "centre": [r.tobytes() for r in c], "share": share})

    order = Window.partitionBy("node").orderBy("place", "vec")
    few = rows.mapInArrow(down, "node bigint, most int, place bigint, vec binary").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * PER_CELL * FAN).where("nth <= most")
    got = few.select("node", "place", "vec").groupBy("node").applyInPandas(fit, "node bigint, centre binary, share double").toArrow()
    node, share = got.column("node").to_numpy(), got.column("share").to_numpy()
    c = np.frombuffer(b"".join(got.column("centre").to_pylist()), np.float32).reshape(-1, dim)
    return [(int(x), c[node == x], share[node == x]) for x in np.unique(node)]


def _placed(rows: DataFrame, model, dim: int, spill: int, beam: int, asked: bool | None) -> DataFrame:
    """``ROW`` of the rows ``(key, v)`` in their ``spill`` best cells."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, quant = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                key, first = np.unique(batch.column(0).to_numpy(), return_index=True)
                vec = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[first])
                code = np.zeros((len(vec), BOOKS), np.uint8) if asked else quant.encode(vec)  # queries are compared by their vectors
                norm = np.maximum(np.linalg.norm(quant.decode(code), axis=1), 1e-6).astype(np.float32)
                one, cell = tree.assign(vec, spill, beam)
                each, part, side = _parts(cell, key[one], tree.blocks, asked)
                each = one[each]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(side), pa.array(key[each]), _fixed(vec[each], 4 * dim), _fixed(code[each], BOOKS), pa.array(norm[each])], names=["part", "side", "key", "vec", "code", "norm"])

    return rows.select("key", "v").mapInArrow(place, ROW)


def _members(usable: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of every id, and of each class of equal vectors its ``k + 1`` smallest ids."""
    members = usable.groupBy("id").agg(F.min("key").alias("key"))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    return members, first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def similar_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", *, k: int = 5, least: float | None = None, dim: int | None = None, spill: int = SPILL, beam: int = TREE_BEAM, seed: int = 7) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: up to ``k`` most similar others of every usable row.

    ``least`` leaves out neighbours of a smaller cosine. ``dim`` is the length of a usable vector, by
    default the most frequent one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    usable, dim, tree, quant = _fit(rows, dim, seed, spill)
    model = df.sparkSession.sparkContext.broadcast((tree, quant))  # at most MODEL_BYTES and the codebooks

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, quant = model.value
        for group in _groups(batches):
            side = group.column("side").to_numpy()
            x = _arrays(group.filter(pa.array(side == 0)), dim)
            y = _arrays(group.filter(pa.array(side == 1)), dim) if side.any() else x
            part = group.column("part")[0].as_py()
            own = (part >> 20) % (1 << 20) == part % (1 << 20)  # one block with itself
            for q, c in ((x, x),) if own else ((x, y), (y, x)):
                if len(q[0]) and (found := _neighbours(quant, q[0], q[1], *c, k, least)):
                    yield _out(found)

    walked = _placed(usable, model, dim, spill, beam, None).repartition("part").sortWithinPartitions("part").mapInArrow(within, PAIRS)
    walked = staged(walked, "cells")
    near = walked.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    # From classes of equal vectors back to ids: of each class the k + 1 smallest ids are enough.
    members, few = _members(usable, k)
    others = near.join(few.select(F.col("key").alias("b"), "ids"), "b").groupBy(F.col("a").alias("key")).agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("minus"), i.alias("id"))))).alias("others"))
    own = few.select("key", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("minus"), i.alias("id"))).alias("own"))
    held = own.where(F.size("own") > 1).join(others, "key", "full_outer").select("key", F.concat(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), F.coalesce("others", F.array().cast(own.schema["own"].dataType))).alias("all"))
    best = members.join(held, "key").select("id", F.slice(F.sort_array(F.filter("all", lambda x: x["id"] != F.col("id"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("pos", "x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.minus")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def search_vectors(df: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", *, k: int = 5, dim: int | None = None, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """``(query_id, neighbour, cosine, rank)``: the ``k`` most similar rows of every query vector.

    ``queries(query_id, embedding)`` is a stated set of any size. Rows lie in their best cell of the same
    index; a query is compared with the rows of its ``probes`` best cells by their codes and stored norms,
    and with all not proven to be further than the best ``k`` exactly. A row with the query's own id never
    counts. Unusable rows and queries are left out; ties go to the smaller id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    usable, dim, tree, quant = _fit(rows, dim, seed, 1)
    asked = queries.select(F.col("query_id"), F.col("embedding").cast("array<float>").alias("v")).where(SOUND.replace("id is not null", "query_id is not null")).where(F.size("v") == dim).withColumn("key", F.xxhash64("v"))
    model = df.sparkSession.sparkContext.broadcast((tree, quant))  # at most MODEL_BYTES and the codebooks

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, quant = model.value
        for group in _groups(batches):
            side = group.column("side").to_numpy()
            q, c = (_arrays(group.filter(pa.array(side == s)), dim) for s in (0, 1))
            if len(q[0]) and len(c[0]):
                one, row, sim = _best(quant, q[1], *c[1:], k + 1, np.full(len(q[0]), -2.0))
                yield _out([q[0][one], c[0][row], sim])

    both = _placed(usable, model, dim, 1, TREE_BEAM, False).union(_placed(asked, model, dim, probes, 2 * probes, True))
    found = both.repartition("part").sortWithinPartitions("part").mapInArrow(within, PAIRS)
    # The query's own class may be the first of k + 1, and of each class k + 1 ids are enough.
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("n") <= k + 1)
    named = near.join(_members(usable, k)[1].select(F.col("key").alias("b"), F.explode("ids").alias("neighbour")), "b").select(F.col("a").alias("key"), "neighbour", "cosine")
    own = asked.groupBy("query_id").agg(F.min("key").alias("key"))
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 6).desc(), "neighbour")
    return own.join(named, "key").where("neighbour <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "neighbour", "cosine", "rank")
