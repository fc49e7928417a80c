"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Corpus-level merge replay. Every worker collects the distinct words of its
slice of the corpus, builds an inverted index from token pair to the positions
that hold it, and applies all merges once, in rank order; a merge updates only
the neighbours it touches. Each distinct word is thereby encoded once per
worker however often it occurs, nothing is shuffled, and the documents are then
assembled from the word table.

Cutting into words is a vectorised pass over the code points. Words are cut
further at byte pairs which no token of the vocabulary contains: no merge can
ever cross such a place, so long runs without spaces (Chinese, Japanese) fall
into few, often repeated segments.

Edge cases: null and empty texts give an empty list of ids; special token
strings inside a text are ordinary text; equal texts give equal ids; an empty
table gives an empty table; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Words a worker remembers between batches. Bounds memory, never the result.
WORD_TABLE = 400_000
#: Code points handled at once by the vectorised passes. A longer document is handled alone.
SLICE_CHARS = 1_500_000

LETTER, NUMBER, SPACE, OTHER, BOUND = 1, 2, 3, 4, 5
# Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# The contractions which the word pattern takes as words.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's rank file, by the installed package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    kind = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            kind[points[m.start() : m.end()]] = value
    kind[WHITE_SPACE] = SPACE
    return kind


def word_starts(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mask of the places where a word begins.

    ``code`` holds code points, ``bounds`` the positions of separators between
    documents; a separator is a word of its own.
    """
    kind = _classes()[code]
    kind[bounds] = BOUND
    n = len(code)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[bounds] = True
    start[bounds[bounds + 1 < n] + 1] = True
    # The last white space before a word stands alone, or joins the word if it is a plain space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BOUND))
    start[last] = True
    joined = last[code[last] == 32] + 1
    start[joined] = False
    # A contraction begins only where its apostrophe begins a word.
    quote = np.flatnonzero((code[:-1] == 39) & start[:-1])
    for text in CONTRACTIONS:
        at = quote[quote + len(text) < n]
        for k, ch in enumerate(text):
            at = at[code[at + 1 + k] == ord(ch)]
        start[at + 1] = False
        after = at + 1 + len(text)
        start[after[after < n]] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return start


class MergeReplay:
    """Encodes sets of distinct words with the merges of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.bridged = {k[i : i + 2] for k in self.rank for i in range(len(k) - 1)}
        self.words: dict[str, tuple[int, ...]] = {}
        self.segments: dict[bytes, tuple[int, ...]] = {}

    def _merged(self, a: int, b: int) -> int:
        """Token that a pair merges into, or -1."""
        got = self.pair.get((a, b))
        if got is None:
            got = self.pair[a, b] = self.rank.get(self.token[a] + self.token[b], -1)
        return got

    def _cut(self, word: bytes) -> list[bytes]:
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.bridged:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each of ``words``, by applying every merge over all of them in rank order."""
        symbol: list[int] = []
        for w in words:
            symbol.extend(map(self.byte.__getitem__, w))
            symbol.append(-1)  # no pair crosses a word's end
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        queue: list[tuple[int, tuple[int, int]]] = []

        def note(a: int, b: int, at: int) -> None:
            if a < 0 or b < 0:
                return
            held = index.get((a, b))
            if held is not None:
                held.append(at)
            elif (r := self._merged(a, b)) >= 0:
                index[a, b] = [at]
                heapq.heappush(queue, (r, (a, b)))

        for i in range(n - 1):
            note(symbol[i], symbol[i + 1], i)
        while queue:
            new, (a, b) = heapq.heappop(queue)
            for at in sorted(index.pop((a, b))):
                right = after[at]
                if symbol[at] != a or right >= n or symbol[right] != b:
                    continue  # a neighbour took it before
                symbol[at], symbol[right] = new, -2
                after[at] = follow = after[right]
                if follow < n:
                    before[follow] = at
                    note(new, symbol[follow], at)
                if (left := before[at]) >= 0:
                    note(symbol[left], new, left)
        out, own = [], []
        for s in symbol:
            if s == -1:
                out.append(tuple(own))
                own = []
            elif s >= 0:
                own.append(s)
        return out

    def learn(self, words: set[str]) -> None:
        """Add new distinct words to the word table."""
        if len(self.segments) > WORD_TABLE:
            self.segments.clear()
        cut = {w: self._cut(w.encode("utf-8", "surrogatepass")) for w in words}
        fresh = list({s for parts in cut.values() for s in parts} - self.segments.keys())
        self.segments.update(zip(fresh, self.replay(fresh)))
        for w, parts in cut.items():
            self.words[w] = tuple(chain.from_iterable(map(self.segments.__getitem__, parts)))

    def encode(self, texts: list[str]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Encoded words of all texts in a row, and the number of words of each text."""
        joined = "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        first = np.flatnonzero(word_starts(code, bounds))
        keep = np.ones(len(first), bool)
        at_bound = np.searchsorted(first, bounds)
        keep[at_bound] = False
        counts = np.diff(at_bound, prepend=-1) - 1
        ends = np.append(first[1:], len(code))[keep].tolist()
        words = [joined[a:b] for a, b in zip(first[keep].tolist(), ends)]
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > WORD_TABLE:
                self.words.clear()
                self.learn(set(words))
            else:
                self.learn({w for w, g in zip(words, got) if g is None})
            got = list(map(self.words.__getitem__, words))
        return got, counts


@lru_cache(maxsize=2)
def _replay(path: str) -> MergeReplay:
    return MergeReplay(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, tokenizer: str = DEFAULT_TOKENIZER, out_col: str = "ids") -> DataFrame:
    """``(id_col, ids array<int>)`` for every row, in one pass without a shuffle."""
    path = path or tokenizer_path(tokenizer)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                got, counts = replay.encode(texts[a:b])
                lengths = np.fromiter(map(len, got), np.int64, len(got))
                ends = np.concatenate(([0], np.cumsum(lengths)))
                flat = np.fromiter(chain.from_iterable(got), np.int32, int(ends[-1]))
                offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[id_col, out_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, `{out_col}` array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", *, path: str | None = None, tokenizer: str = DEFAULT_TOKENIZER, out_col: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text (0 for null and empty)."""
    path = path or tokenizer_path(tokenizer)
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{out_col}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in _slices(texts):
                got, counts = replay.encode(texts[a:b])
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))))
                sizes = np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(sizes)], names=[*keep, out_col])

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(run, schema)
