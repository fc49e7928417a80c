"""Near-duplicate records with small edits: a MinHash LSH forest with exact verification.

A record is the set of its distinct triples of consecutive words (``width`` words in general). Records
with the same word sequence form one class and are handled once, so any number of copies costs one
entry. Each class gets ``TREES * STRIDE`` MinHash coordinates of 16 bits, set in a ring. Tree number i is the
sorted list of paths of ``COORDS`` coordinates from place i * ``STRIDE`` of that ring on: up to depth ``STRIDE``
the trees share no coordinate. Classes that share a prefix of a path are candidates, and how long that prefix
must be is decided node by node, from the longest on:

* A prefix is shortened at least to the depth at which the recall expected at the similarity threshold reaches
  ``recall``: with the defaults of the registered queries (0.5, 0.98) to 3 of 8 coordinates, at a threshold of
  0.8 to 7. So every node of that depth is compared in full, however large it is.
* It is shortened by one more coordinate where the shorter node holds at most ``SMALL`` classes, which raises the
  recall further, as long as chance would give a class less than one partner at that depth (n * TREES <= 2^(16 depth)).

A node expected, by a sample, to hold more than ``node_rows`` classes is not sent to one task: its rows go out as
blocks from the start, and each pair of blocks is compared in a task of its own. Wide nodes that are to be shortened
are sent by the longer prefix instead.

Within a node only those pairs go on whose 128-bit sketches (a further bit of each coordinate, and one more of a
third of them) agree in ``SKETCH_AGREE`` bits at least, then those that agree in enough coordinates; both bounds lie at least
``SIGMAS`` standard deviations below what a pair at the threshold shows. What is left is verified exactly
on the texts, which are read again for the candidates only.

Edge cases: rows with a null id are left out; rows that repeat an id are one record; null, empty and short texts have no partners;
records with equal word sequences are copies of similarity 1; an empty table gives empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.graph import connected_components
from lexloom.session import staged

#: Trees, coordinates between the beginnings of two trees' paths, and the length of a path.
TREES, STRIDE, COORDS = 32, 3, 8
RING = TREES * STRIDE
#: Rows of a forest node that one task compares.
NODE_ROWS = 4096
#: Classes of a node up to which its prefix is shortened beyond what the recall asks for.
SMALL = 16
#: Classes of the sample that large nodes are found in, and rows of it that tell a large node from chance.
SAMPLE, SURE = 1 << 16, 12
#: Of 128 sketch bits; a pair at similarity 0.5 agrees in 96 with a standard deviation of 5.3, an unrelated one in 64 with 5.7.
SKETCH_AGREE = 78
SIGMAS = 3.4
#: Bits of the fixed-size filter that spares reading texts of records without candidates.
FILTER_BITS = 1 << 24
#: Copies of one class that one task pairs with as many others.
COPY_ROWS = 1000

WORD = re.compile(r"[^\W_]+")


def expected_recall(threshold: float, depth: int) -> float:
    """Chance that a pair of that similarity shares a prefix of that depth in some tree."""
    if depth <= STRIDE:
        return 1 - (1 - threshold**depth) ** TREES
    # beyond, trees share coordinates: by drawing
    agree = np.random.default_rng(1).random((20_000, RING)) < threshold
    hit = np.ones((len(agree), TREES), bool)
    for level in range(depth):
        hit &= agree[:, (np.arange(TREES) * STRIDE + level) % RING]
    return float(hit.any(1).mean())


def depth_for(threshold: float, recall: float) -> int:
    """Longest prefix that still gives the recall at the threshold (1 at least)."""
    return next((d for d in range(COORDS, 1, -1) if expected_recall(threshold, d) >= recall), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word-window hashes of batches of texts; remembers the hashes of words seen."""

    def __init__(self, width: int, min_words: int):
        import xxhash

        self.hash, self.width, self.min_words = xxhash.xxh3_64_intdigest, width, min_words
        self.words: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the texts long enough, start of each one's windows, hashes of all windows."""
        if len(self.words) > 1_000_000:
            self.words.clear()
        which, sizes, flat = [], [], []
        for i, text in enumerate(texts):
            if text is None:
                continue
            words = WORD.findall(text.lower())
            if len(words) >= self.min_words:
                which.append(i)
                sizes.append(len(words))
                flat.extend(words)
        known, digest = self.words, self.hash
        for w in set(flat) - known.keys():
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        size = np.array(sizes, np.int64)
        if not len(size):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        total = len(h) - self.width + 1
        window = np.zeros(total, np.uint64)
        for k in range(self.width):
            window = _mix(window * np.uint64(0x9E3779B97F4A7C15) + h[k : k + total])
        end = np.cumsum(size)
        valid = np.ones(len(h), bool)
        for k in range(1, self.width):
            valid[end - k] = False
        starts = np.concatenate(([0], np.cumsum(size - self.width + 1)[:-1]))
        return np.array(which, np.int64), starts, window[valid[:total]]


def _signatures(window: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ring of 16-bit coordinates of each text, and its 128-bit sketch in two numbers."""
    rng = np.random.default_rng(11)
    a = rng.integers(1, 2**32, RING, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, RING, np.uint64).astype(np.uint32)
    low, high = window.astype(np.uint32), (window >> np.uint64(32)).astype(np.uint32)
    ring = np.zeros((len(starts), RING), np.uint16)
    sketch = np.zeros((len(starts), 2), np.uint64)
    for k in range(RING):
        v = low * a[k] + (high ^ b[k])
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(v, starts)
        # the least values crowd near 0: mix them before taking bits
        least = (least ^ (least >> np.uint32(16))) * np.uint32(0x7FEB352D)
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x846CA68B)
        least ^= least >> np.uint32(16)
        ring[:, k] = least & np.uint32(0xFFFF)
        sketch[:, k // 64] |= ((least >> np.uint32(16)) & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
        if k < 128 - RING:
            sketch[:, 1] |= ((least >> np.uint32(17)) & np.uint32(1)).astype(np.uint64) << np.uint64(RING - 64 + k)
    return ring, sketch.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, min_words: int) -> DataFrame:
    """``(id, class, n_words, low, high, sketch, sketch2)`` of every row long enough; one pass, no shuffle. ``low`` and
    ``high`` hold the lower and upper bytes of the ring's coordinates, eight in each bigint."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(width, max(min_words, width))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                which, starts, window = shingle(texts)
                if not len(which):
                    continue
                ring, sketch = _signatures(window, starts)
                sizes = np.diff(np.append(starts, len(window))) + width - 1
                own = [xxhash.xxh3_64_intdigest("\x1f".join(WORD.findall(texts[i].lower()))) for i in which.tolist()]
                low, high = (pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.uint8).view(np.int64).ravel()), RING // 8).cast(pa.list_(pa.int64())) for x in (ring & 255, ring >> 8))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which)), pa.array(np.array(own, np.uint64).astype(np.int64)), pa.array(sizes.astype(np.int32)), low, high, *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in (0, 1))],
                    names=["id", "class", "n_words", "low", "high", "sketch", "sketch2"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, class bigint, n_words int, low array<bigint>, high array<bigint>, sketch bigint, sketch2 bigint")


def _nodes(batch: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (n, TREES) of the nodes at ``depth`` and one above it, from the ring's bytes."""
    low, high = (np.ascontiguousarray(batch.column(c).flatten().to_numpy()).view(np.uint8).reshape(-1, RING).astype(np.uint16) for c in ("low", "high"))
    ring = low | (high << np.uint16(8))
    tree = np.arange(TREES)
    node = above = np.broadcast_to((tree + 1).astype(np.uint64), (len(ring), TREES))
    for level in range(depth):
        above, node = node, _mix(node * np.uint64(0x9E3779B97F4A7C15) + ring[:, (tree * STRIDE + level) % RING] + np.uint64(1))
    return node.view(np.int64), _mix(above + np.uint64(0x5851F42D4C957F2D)).view(np.int64)  # apart from ids of the lower level


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(a ^ b)
    return differ[..., 0] + differ[..., 1] <= 128 - SKETCH_AGREE


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


LEFT, RIGHT = -1, -2  # in the place of a node: sides of two blocks of one node
ROW = ["part", "node", "class", "sketch", "sketch2"]


def _within(start: np.ndarray, size: np.ndarray, cls: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Close pairs within each of the groups that begin at ``start``."""
    for k in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        left, right = np.triu_indices(k, 1)
        own = start[size == k]
        step = max(1, 1_000_000 // len(left))
        for s in range(0, len(own), step):
            x, y = (own[s : s + step, None] + left).ravel(), (own[s : s + step, None] + right).ravel()
            ok = _close(sketch[x], sketch[y])
            if ok.any():
                yield _batch(cls[x[ok]], cls[y[ok]])
    for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist()):
        yield from _across(cls[s : s + n], sketch[s : s + n], None, None)


def _across(cls, sketch, other, other_sketch) -> Iterator[pa.RecordBatch]:
    """Close pairs of two blocks, or of one with itself; a row at a time against all others."""
    a, b, n = [], [], 0
    for i in range(len(cls)):
        c, s = (cls[i + 1 :], sketch[i + 1 :]) if other is None else (other, other_sketch)
        at = np.flatnonzero(_close(sketch[i], s))
        if len(at):
            a.append(np.full(len(at), cls[i]))
            b.append(c[at])
            n += len(at)
        if n > 500_000 or (n and i == len(cls) - 1):
            yield _batch(np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0


def _walk(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs ``(a, b)`` of a stream sorted by part and node.

    A part is two blocks of a node, or a node, or several nodes below a shorter prefix: these are one node
    if they hold at most ``small`` classes together.
    """
    held: list[list[np.ndarray]] = []

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, node, cls, sketch = cols
        edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        size = np.diff(edges)
        sided = (node[edges[:-1]] == LEFT) | (node[edges[:-1]] == RIGHT)
        for k in np.flatnonzero(sided).tolist():
            s, e = edges[k], edges[k + 1]
            left = node[s:e] == LEFT
            yield from _across(cls[s:e][left], sketch[s:e][left], cls[s:e][~left], sketch[s:e][~left])
        few = ~sided & (size <= small)
        yield from _within(edges[:-1][few], size[few], cls, sketch)
        many = np.repeat(~sided & (size > small), size)
        if many.any():
            part, node, cls, sketch = part[many], node[many], cls[many], sketch[many]
            edges = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (node[1:] != node[:-1])) + 1, [len(part)]))
            yield from _within(edges[:-1], np.diff(edges), cls, sketch)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(cols[0]):
            continue
        cols[3:] = [np.stack(cols[3:], 1).view(np.uint64)]
        cut = np.flatnonzero(cols[0] != cols[0][-1])
        last = cut[-1] + 1 if len(cut) else 0  # where the group begins that may go on in the next batch
        if held and (last or held[-1][0][-1] != cols[0][-1]):
            yield from pairs([np.concatenate([h[i] for h in held] + [cols[i][:last]]) for i in range(4)])
            held = []
        elif last:
            yield from pairs([c[:last] for c in cols])
        held.append([c[last:] for c in cols])
    if held:
        yield from pairs([np.concatenate([h[i] for h in held]) for i in range(4)])


def candidates(classes: DataFrame, threshold: float, recall: float, node_rows: int = NODE_ROWS, n: int | None = None) -> DataFrame:
    """Distinct candidate pairs ``(a, b)`` of ``classes(class, low, high, sketch, sketch2)``, ``a < b``."""
    spark = classes.sparkSession
    depth = depth_for(threshold, recall)
    n = classes.count() if n is None else n
    shorten = depth > 1 and n * TREES <= 1 << (16 * (depth - 1))

    # Large nodes of both levels, by a bounded sample: at most SAMPLE * TREES * 2 / SURE of them.
    share = min(1.0, SAMPLE / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(3), "class"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["class"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, above = _nodes(batch, depth)
            ids, count = np.unique(np.concatenate((node.ravel(), above.ravel())) if shorten else node.ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count)], names=["node", "n"])

    least = node_rows * share if share == 1 else max(SURE, node_rows * share)
    found = drawn.select("low", "high").mapInArrow(seen, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > least).orderBy("node").toArrow()
    blocks = np.ceil(found.column("n").to_numpy() / share / node_rows).astype(np.int64)
    large = spark.sparkContext.broadcast((found.column("node").to_numpy(), blocks))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, many = large.value

        def n_blocks(node: np.ndarray) -> np.ndarray:
            if not len(ids):
                return np.ones(len(node), np.int64)
            at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            return np.where(ids[at] == node, many[at], 1)

        def short(node: np.ndarray) -> np.ndarray:
            """31 bits are enough to tell the nodes of one part."""
            return (node.view(np.uint64) >> np.uint64(33)).astype(np.int32)

        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                node, above = (x.ravel() for x in _nodes(batch, depth))
                cls = np.repeat(batch.column("class").to_numpy(), TREES)
                one_each, two_each = (np.repeat(batch.column(c).to_numpy(), TREES) for c in ("sketch", "sketch2"))
                times = n_blocks(node)
                part = np.where(n_blocks(above) > 1, node, above) if shorten else node
                one = times == 1
                yield pa.RecordBatch.from_arrays([pa.array(x[one]) for x in (part, short(node), cls, one_each, two_each)], names=ROW)
                if one.all():
                    continue
                node, cls, one_each, two_each, times = (x[~one] for x in (node, cls, one_each, two_each, times))
                each = np.repeat(np.arange(len(node)), times)
                other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                own = ((_mix(cls.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % times)[each]
                left, right = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                part = _mix(_mix(node[each].view(np.uint64) + left) * np.uint64(0x9E3779B97F4A7C15) + right).view(np.int64)
                side = np.where(own == other, short(node[each]), np.where(own < other, LEFT, RIGHT)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, side, cls[each], one_each[each], two_each[each])], names=ROW)

    rows = classes.select("class", "low", "high", "sketch", "sketch2").mapInArrow(spread, "part bigint, node int, class bigint, sketch bigint, sketch2 bigint")
    small = SMALL if shorten else 0
    return rows.repartition("part").sortWithinPartitions("part", "node").mapInArrow(lambda batches: _walk(batches, small), "a bigint, b bigint").where("a <> b").distinct()


def _verify(threshold: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, score = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = WORD.findall(x.lower()), WORD.findall(y.lower())
                x, y = set(zip(*(x[k:] for k in range(width)))), set(zip(*(y[k:] for k in range(width))))
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
                    score.append(both / (len(x) + len(y) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


def similar_classes(df: DataFrame, id_col: str = "id", text_col: str = "text", *, threshold: float = 0.8, width: int = 5, min_words: int = 5, recall: float = 0.98, node_rows: int = NODE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``(id, class)`` of every record long enough, and the verified pairs
    ``(a, b, similarity)`` of classes with ``a < b``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = staged(signatures(rows, "id", "text", width, min_words), "signatures")
    members = signed.select("id", "class").distinct()
    # Rows of one class have equal signatures, so any row stands for it.
    classes = signed.groupBy("class").agg(F.min("id").alias("id"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("sketch").alias("sketch"), F.first("sketch2").alias("sketch2"))
    found = candidates(classes.select("class", "low", "high", "sketch", "sketch2"), threshold, recall, node_rows, signed.count())
    # Of the lower bytes, which agree at least as often as the coordinates: half of what would have to be shuffled.
    least = math.floor(RING * threshold - SIGMAS * math.sqrt(RING * threshold * (1 - threshold)))
    side = classes.select("class", "low", "id")
    joined = found.join(side.select(F.col("class").alias("a"), F.col("low").alias("pa"), F.col("id").alias("ia")), "a").join(side.select(F.col("class").alias("b"), F.col("low").alias("pb"), F.col("id").alias("ib")), "b")
    equal = F.aggregate(F.zip_with("pa", "pb", lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda s, x: s + sum((F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)) == F.lit(0)).cast("int") for k in range(8)))
    likely = staged(joined.where(equal >= least).select("a", "b", "ia", "ib"), "likely")
    # Read the texts of the classes that are left. A bitmap of fixed size keeps other rows from the shuffle.
    needed = likely.select(F.col("a").alias("class"), F.col("ia").alias("id")).union(likely.select("b", "ib")).distinct()
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bitmap = needed.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, cast((p % 32768) div 8 + 1 as int), 1)), 16, 10) as int), cast(p % 8 as int)) & 1 = 1")
    near = rows.where("text is not null").withColumn("p", place).withColumn("part", F.expr("p div 32768")).join(F.broadcast(bitmap), "part")
    near = near.where(bit).select("id", "text")
    texts = needed.join(near, "id").groupBy("class").agg(F.first("text").alias("text"))
    with_text = likely.select("a", "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    pairs = with_text.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold, width), "a bigint, b bigint, similarity double")
    return members, staged(pairs, "pairs")


def similar_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b``: all pairs of records of verified classes, and of copies.

    The pairs of a class of many copies are spread over tasks in blocks of ``COPY_ROWS``. ``groups`` is the
    form that stays linear in the records.
    """
    sized = members.groupBy("class").agg(F.count("*").alias("n"))
    copies = members.join(sized.where("n > 1"), "class")
    n_blocks = F.ceil(F.col("n") / COPY_ROWS).cast("int")
    placed = copies.select("class", "id", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    left = placed.select("class", F.col("block").alias("l"), every.alias("r"), F.col("id").alias("id_a"))
    right = placed.select("class", every.alias("l"), F.col("block").alias("r"), F.col("id").alias("id_b"))
    each = left.join(right, ["class", "l", "r"]).where("id_a < id_b").select("id_a", "id_b")
    linked = pairs.select("a", "b")
    across = linked.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return each.union(across)


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, group, n_links)`` of every record long enough: the smallest id it is linked to, directly
    or through others, and the number of other texts its own text is similar to."""
    component = connected_components(pairs, "a", "b")
    links = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count("*").alias("n_links"))
    placed = members.join(component.select(F.col("node").alias("class"), "component"), "class", "left").join(links, "class", "left").select("id", F.coalesce("component", "class").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = placed.groupBy("component").agg(F.min("id").alias("group"))
    return placed.join(named, "component").select("id", "group", "n_links")
