"""Splitting of oversized texts at natural boundaries by dynamic programming.

A text is normalised first: CR LF and single CR become LF, white space at both ends goes. If it is
longer than ``size`` code points, pieces of at most ``size`` are cut. Candidate places for a cut are
ranked: paragraph, line, sentence, clause, word, before East Asian punctuation, and only inside
stretches too long for a piece, any place between two grapheme-like units. For every candidate the
cheapest way to reach it is found, adding the penalty of the kind of cut, the squared deviation of the
piece from the even length, and the overlap that had to be given up. A piece after the first begins at
the first sentence or else word start at most ``overlap`` before the cut that ended the piece before;
where the next boundary is too far away for that, it begins later, at the cut itself if need be. Inside
an unbreakable stretch the pieces share exactly ``overlap`` code points.

Candidates are thinned to the best one in each ``grid`` code points (30; 1 keeps all and is exact); places beside long stretches always
stay, and so do all between two places that would else be further apart than a piece, so a text that can be
cut without a forced cut always is, and no piece is longer than ``size``. A run of marks without a base that
is longer than a piece is cut before a mark. The work for a text of n code points is
O(n * size / grid^2).

Edge cases: null and blank texts give no piece, a short text one piece; ties between ways go to the
earlier cut; repeated rows are cut alike; an empty table gives an empty table. Pieces never begin or end
with white space; together they hold all of the text's other code points.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, GRID = 900, 150, 30
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, BEFORE, FORCED, END = range(8)
KINDS = ["paragraph", "line", "sentence", "clause", "word", "punctuation", "forced", "end"]
#: Penalty by kind of cut, in the units of the squared relative deviation from the even length.
PENALTY = [0.0, 0.05, 0.1, 0.6, 1.2, 3.0, 1000.0, 0.0]
OVERLAP_LOST = 0.15

# East Asian punctuation that separates words, those of them that end a sentence.
MARKS, STOPS = "。！？；，、", "。！？"
SPACES = re.compile(r"\s+")
MARK = re.compile(f"[{MARKS}]+[」』”’）)]*")
CLOSERS = "\"'”’»)]）」』"
STRETCH = re.compile(rf"[^\s{MARKS}]+")


def normalise(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def _kind_of_gap(text: str, at: int, gap: str) -> int:
    """Kind of the cut at white space ``gap`` that begins at ``at``."""
    lines = gap.count("\n")
    if lines > 1:
        return PARAGRAPH
    if lines:
        return LINE
    k = at - 1
    while k > 0 and text[k] in CLOSERS:
        k -= 1
    return SENTENCE if text[k] in ".!?…" or text[k] in STOPS else CLAUSE if text[k] in ";:," or text[k] in MARKS else WORD


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a mark from its base."""
    c = text[at]
    return unicodedata.combining(c) != 0 or c in "‍︎️" or text[at - 1] == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff" or unicodedata.category(c) in ("Mn", "Me")


def _forced_places(text: str, a: int, b: int, step: int, reach: int) -> list[int]:
    """Places for cuts in the stretch from ``a`` to ``b``, every ``step`` code points and at most ``reach``
    apart: between two units where there is such a place, else before a mark."""
    grid = []
    for k in range(a + step, b, step):
        while k < b and _joined(text, k):
            k += 1
        if k < b:
            grid.append(k)
    out, last = [], a
    for k in [*grid, b]:
        while k - last > reach:
            last = next((t for t in range(last + reach, last, -1) if not _joined(text, t)), last + reach)
            out.append(last)
        if k < b:
            out.append(k)
        last = k
    return out


def boundaries(text: str, size: int = SIZE, overlap: int = OVERLAP, grid: int = GRID) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Candidate cuts ``(end, start, kind)`` in order: a piece may end at ``end``, the next text begins
    at ``start``. Beside them the sentence and line starts, and all word starts."""
    found: dict[tuple[int, int], int] = {}
    good, fine = [], []
    for m in SPACES.finditer(text):
        a, b = m.span()
        kind = found[a, b] = WORD if b - a == 1 and text[a - 1].isalnum() and text[a] != "\n" else _kind_of_gap(text, a, m.group())
        fine.append(b)
        if kind <= SENTENCE:
            good.append(b)
    for m in MARK.finditer(text):
        a, b = m.span()
        if b < len(text) and not text[b].isspace():
            found.setdefault((b, b), SENTENCE if text[a] in STOPS else CLAUSE)
            fine.append(b)
            if text[a] in STOPS:
                good.append(b)
        for k in range(a, a + 1 + sum(c in MARKS for c in m.group()[1:])):
            if k and not text[k - 1].isspace():
                found.setdefault((k, k), BEFORE)
    tight: set[int] = set()  # starts and ends of stretches that leave little freedom
    for m in STRETCH.finditer(text):
        a, b = m.span()
        if b - a > size - 2 * grid:
            tight |= {a, b}
            if a and text[a - 1] in MARKS:
                found.setdefault((a, a), BEFORE)  # its closing signs alone may be too long for the mark's piece
        if b - a > size:
            reach = size - overlap if overlap < size else 1  # what a piece that begins with the overlap can hold
            for k in _forced_places(text, a, b, min(grid, reach), reach):
                found.setdefault((k, k), FORCED)
    whole = [(end, start, kind) for (end, start), kind in sorted(found.items())]
    whole.append((len(text), len(text), END))
    out: list[tuple[int, int, int]] = []
    for end, start, kind in whole[:-1]:
        if out and end // grid == out[-1][0] // grid and not ({end, start} & tight or {out[-1][0], out[-1][1]} & tight):
            if kind <= out[-1][2]:
                out[-1] = (end, start, kind)
        else:
            out.append((end, start, kind))
    out.append(whole[-1])
    # Thinning may part two neighbours, with the white space between them, by more than a piece: all between come back.
    thin, out, free, at = out, [], 0, 0
    for cut in thin:
        to = bisect.bisect_left(whole, cut, at)
        if cut[0] - free > size:
            out += whole[at:to]
        out.append(cut)
        at, free = to + 1, cut[0] - overlap if cut[2] == FORCED else cut[1]
    return out, sorted(good), sorted(fine)


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, grid: int = GRID) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, kind of the cut at the end)`` of a normalised text."""
    return cheapest(text, size, overlap, grid)[0]


def cheapest(text: str, size: int = SIZE, overlap: int = OVERLAP, grid: int = GRID) -> tuple[list[tuple[int, int, int]], float]:
    """Pieces and what they cost: penalties, deviations from the even length, overlap given up."""
    n = len(text)
    if n == 0:
        return [], 0.0
    if n <= size:
        return [(0, n, END)], 0.0
    cuts, good, fine = boundaries(text, size, overlap, grid)
    # One way from the text's start to each cut: cost, cut before (-1: none), start of the piece.
    count = len(cuts)
    ends = [c[0] for c in cuts]
    even_pieces = max(2, -(-(n - overlap) // (size - overlap)))
    even = min(size, n / even_pieces + overlap * (even_pieces - 1) / even_pieces)
    cost = [float("inf")] * count
    came, began = [-2] * count, [0] * count

    def start_for(i: int, end: int) -> int:
        """Where the piece after cut ``i`` begins if it ends at ``end``."""
        stop, resume, kind = cuts[i]
        least = stop - overlap if kind == FORCED else max(stop - overlap, end - size)
        if least >= resume:
            return resume
        if kind == FORCED:
            inside = max(least, 0)
            k = bisect.bisect_left(fine, inside)
            inside_stretch = k == len(fine) or fine[k] >= stop
            at = inside if inside_stretch else fine[k]
            while at < stop and at and _joined(text, at):
                at += 1
            return at
        for starts in (good, fine):
            k = bisect.bisect_left(starts, least)
            if k < len(starts) and starts[k] < stop:
                return starts[k]
        return resume

    def given_up(i: int, s: int) -> float:
        stop = cuts[i][0]
        return OVERLAP_LOST * (1 - min(overlap, stop - s) / overlap if s < stop else 1) if overlap else 0.0

    # Start of the piece after each cut and what its overlap costs, wherever that piece may end.
    usual = [start_for(i, 0) for i in range(count - 1)]
    base = [0.0] * count
    resumes = [c[1] for c in cuts]
    for j in range(count):
        end = ends[j]
        penalty = PENALTY[cuts[j][2]]
        best, via, at = float("inf"), -2, 0
        if end <= size:
            best, via = penalty + ((end - even) / size) ** 2, -1
        for i in range(j - 1, -1, -1):
            if end - resumes[i] > size:
                break
            s, c = usual[i], base[i]
            if end - s > size:
                s = start_for(i, end)
                if s >= end or end - s > size:
                    continue
                c = cost[i] + given_up(i, s)
            elif s >= end:
                continue
            off = (end - s - even) / size
            c += penalty + off * off
            if c <= best - 1e-12:
                best, via, at = c, i, s
        cost[j], came[j], began[j] = best, via, at
        if j < count - 1:
            base[j] = best + given_up(j, usual[j])
    out = []
    j = count - 1
    while j >= 0:
        out.append((began[j] if came[j] >= 0 else 0, ends[j], cuts[j][2]))
        j = came[j]
    assert all(e - s <= size for s, e, _ in out), "a piece is longer than the size"
    return out[::-1], cost[-1]


def split_records(df: DataFrame, id_col: str = "id", text_col: str = "text", page_col: str = "page", *, size: int = SIZE, overlap: int = OVERLAP, grid: int = GRID, only_oversized: bool = False) -> DataFrame:
    """``(id, page, piece_no, n_pieces, start, end, cut, text)``: the pieces of every row.

    ``start`` and ``end`` are code points in the normalised text, ``cut`` the kind of boundary at the
    piece's end. With ``only_oversized`` rows of ``size`` code points or fewer are left out before Python.
    """
    if size < 1 or not 0 <= overlap < size or grid < 1:
        raise ValueError("size and grid must be positive and overlap between 0 and size")
    id_type, page_type = df.schema[id_col].dataType.simpleString(), df.schema[page_col].dataType.simpleString()
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), F.col(text_col).alias("text"))
    if only_oversized:
        rows = rows.where(F.length("text") > size)
    names = ["id", "page", "piece_no", "n_pieces", "start", "end", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, no, of, start, end, cut, piece = [], [], [], [], [], [], []
                for i, raw in enumerate(batch.column(2).to_pylist()):
                    text = normalise(raw)
                    if only_oversized and len(text) <= size:
                        continue
                    parts = split(text, size, overlap, grid)
                    for k, (s, e, kind) in enumerate(parts):
                        row.append(i)
                        no.append(k)
                        of.append(len(parts))
                        start.append(s)
                        end.append(e)
                        cut.append(KINDS[kind])
                        piece.append(text[s:e])
                at_rows = pa.array(row, pa.int64())
                ints = [pa.array(x, pa.int32()) for x in (no, of, start, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), batch.column(1).take(at_rows), *ints, pa.array(cut, pa.string()), pa.array(piece, pa.string())], names=names)

    return rows.mapInArrow(run, f"id {id_type}, page {page_type}, piece_no int, n_pieces int, start int, end int, cut string, text string")
