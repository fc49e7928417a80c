"""Languages of records and of the runs of lines inside them, by string kernels.

A line is the set of its n-grams of 1 to ``GRAMS`` code points (lower-cased letters, anything else a
space), hashed to ``BUCKETS``. The kernel of two lines is the number of n-grams present in both over the
geometric mean of their sizes (a blended-spectrum presence kernel). One-versus-rest kernel ridge
regression is fitted on a bounded sample of labelled records (``PER_LABEL`` records of each language, the
smallest hashes of their ids) with Nyström landmarks; lines that contradict their record's label are left
out of a second fit. A further class holds letter strings that are no words: anagrams of sample lines and
random strings over several alphabets.

Scores are linear in a line's n-grams, so landmarks and weights fold into one table of a score per n-gram
and class; a batch of lines is scored by one product of its sparse presence matrix with that table. All
records are scored in full, in one pass without a shuffle.

A line counts if it has ``MIN_LETTERS`` letters. Consecutive counting lines of one language form a
segment; lines that don't count belong to the segment before them.

Edge cases: null, empty and letterless texts hold no language; a record without a counting line gets
no segment; ties go to the language earlier in ``LANGUAGES``; if no row has a usable label nothing can be
fitted and no language is found; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.tokenise import LETTER, _classes

LANGUAGES = ["en", "de", "fr", "es", "pt", "zh", "ja", "ko"]
# Usual forms of the languages' names (two- and three-letter codes, English names).
FORMS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish", "castilian"],
    "pt": ["pt", "por", "portuguese"],
    "zh": ["zh", "zho", "chi", "chinese", "cmn", "mandarin"],
    "ja": ["ja", "jpn", "japanese"],
    "ko": ["ko", "kor", "korean"],
}
MIN_LETTERS, GRAMS, BITS = 20, 3, 18
BUCKETS = 1 << BITS
#: Bounds of the sample that is fitted on: records of each label, lines of each label, landmarks of each class.
PER_LABEL, LINES_PER_LABEL, LANDMARKS = 80, 350, 60
RIDGE, NONE_LINES = 0.3, 700
SLICE_CHARS = 400_000
NONE = len(LANGUAGES)


def label_language(label: Column) -> Column:
    """The language a label names in any usual form, else null."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[^a-z].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, forms in FORMS.items():
        out = F.when(first.isin(forms), code).otherwise(out)
    return out


class Lines:
    """The counting lines of a batch of texts and their n-grams."""

    def __init__(self, texts: list[str | None], min_letters: int = MIN_LETTERS):
        plain = [(t or "").replace("\r\n", "\n").replace("\r", "\n").lower() for t in texts]
        joined = "\n".join(plain) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = code == 10
        line = np.cumsum(ends) - ends
        letter = _classes()[code] == LETTER
        letters = np.bincount(line[letter], minlength=int(line[-1]) + 1)
        counts = letters >= min_letters
        per_text = np.array([p.count("\n") + 1 for p in plain])
        first = np.concatenate(([0], np.cumsum(per_text)[:-1]))
        self.which = np.flatnonzero(counts)  # global numbers of the counting lines
        self.text = np.searchsorted(first, self.which, side="right") - 1
        self.line_no = self.which - first[self.text]
        self.letters = letters[self.which]
        self.last_line = per_text - 1
        own = counts[line]
        code, letter, line = code[own], letter[own], line[own]
        unit = np.where(letter, code, 32).astype(np.uint32)
        keep = np.ones(len(unit), bool)
        keep[1:] = (unit[1:] != 32) | (unit[:-1] != 32) | (line[1:] != line[:-1])
        self.unit = unit[keep]
        rank = np.zeros(len(counts), np.int64)
        rank[self.which] = np.arange(len(self.which))
        self.line = rank[line[keep]]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the lines in, and values of, the concatenated distinct n-grams of each line."""
        n = len(self.unit)
        parts, h = [], np.zeros(n, np.uint32)
        for k in range(GRAMS):
            m = n - k
            if m <= 0:
                break
            h = (h[:m] * np.uint32(0x01000193)) ^ (self.unit[k:] * np.uint32(0x9E3779B1) + np.uint32(k))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bucket = ((h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)
            both = (self.line[:m] << BITS) | bucket
            parts.append(both if not k else both[self.line[:m] == self.line[k:]])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.sort(np.concatenate(parts))
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        return np.searchsorted(both, np.arange(len(self.which)) << BITS), both & (BUCKETS - 1)


def _sets(texts: list[str]) -> list[np.ndarray]:
    lines = Lines(texts, 1)
    starts, gram = lines.grams()
    return np.split(gram, starts[1:]) if len(starts) else []


class KernelRidge:
    """One-versus-rest kernel ridge regression with Nyström landmarks over n-gram sets."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.column = np.full(BUCKETS, -1, np.int64)
        used = np.unique(np.concatenate(landmarks))
        self.column[used] = np.arange(len(used))
        self.used, self.size = used, np.sqrt([len(x) for x in landmarks])
        self.z = self._dense(landmarks)

    def _dense(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.used)), np.float32)
        for i, s in enumerate(sets):
            c = self.column[s]
            out[i, c[c >= 0]] = 1
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of each set with each landmark, by batched matrix products."""
        out = []
        for s in range(0, len(sets), 400):
            part = sets[s : s + 400]
            out.append((self._dense(part) @ self.z.T) / np.outer(np.sqrt([len(x) for x in part]), self.size))
        return np.concatenate(out)

    def fit(self, sets: list[np.ndarray], label: np.ndarray, classes: int) -> np.ndarray:
        """Score of each bucket for each class; a line's score is their sum over its n-grams, over the root of their number."""
        value, vector = np.linalg.eigh(self.kernel(self._own()).astype(np.float64))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = self.kernel(sets) @ root
        y = np.where(label[:, None] == np.arange(classes), 1.0, -1.0)
        # each class has the same weight, however many lines the sample has of it
        weight = 1 / np.maximum(np.bincount(label, minlength=classes), 1)[label]
        weight *= len(label) / weight.sum()
        w = np.linalg.solve((phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
        alpha = root @ w
        table = np.zeros((BUCKETS, classes), np.float32)
        table[self.used] = self.z.T @ (alpha / self.size[:, None]).astype(np.float32)
        return table

    def _own(self) -> list[np.ndarray]:
        return [self.used[np.flatnonzero(row)] for row in self.z]


def scores(table: np.ndarray, starts: np.ndarray, gram: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    size = np.diff(np.append(starts, len(gram)))
    return np.add.reduceat(table[gram], starts, axis=0) / np.sqrt(size)[:, None]


def _wordless(lines: list[str], rng: np.random.Generator) -> list[str]:
    """Letter strings that are no words: anagrams of sample lines, and random strings."""
    out = []
    for i in rng.permutation(len(lines))[: NONE_LINES // 2]:
        chars = [c for c in lines[i] if c.isalpha()]
        if chars[0] < "⺀":  # alphabets only: any order of ideographs may be words
            mixed = rng.permutation(chars).tolist()
            cut = rng.random(len(mixed)) < 0.18
            out.append("".join(c + " " * int(k) for c, k in zip(mixed, cut)))
    # Alphabets of machine-made strings.
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "abcdef0123456789/", "ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz     ", "bcdfghjklmnpqrstvwxz ", "0123456789abcdef"]
    while len(out) < NONE_LINES:
        alphabet = alphabets[len(out) % len(alphabets)]
        out.append("".join(alphabet[k] for k in rng.integers(0, len(alphabet), int(rng.integers(60, 400)))))
    return out


def fit(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "lang", seed: int = 5) -> np.ndarray | None:
    """Score table fitted on the bounded sample, or None if no row has a usable label."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("label")).where("label is not null and text is not null")
    order = F.xxhash64(F.lit(seed), "id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "id"))
    chosen = [r[0] for r in rows.select("id", "label").distinct().withColumn("n", rank).where(F.col("n") <= PER_LABEL).select("id").collect()]
    if not chosen:
        return None
    drawn = sorted({(r["id"], r["label"], r["text"]) for r in rows.where(F.col("id").isin(chosen)).dropDuplicates(["id"]).toLocalIterator()})
    rng = np.random.default_rng(seed)
    text, label = [], []
    for code in range(NONE):
        own = [line for _, lang, t in drawn if lang == LANGUAGES[code] for line in t.replace("\r", "\n").split("\n") if sum(map(str.isalpha, line)) >= MIN_LETTERS]
        for k in rng.permutation(len(own))[:LINES_PER_LABEL]:
            text.append(own[k])
            label.append(code)
    odd = _wordless(text, rng)
    text, label = text + odd, np.array(label + [NONE] * len(odd))
    sets = _sets(text)
    sure = np.ones(len(sets), bool)
    for _ in range(3):
        marks = [k for c in range(NONE + 1) for k in rng.permutation(np.flatnonzero(sure & (label == c)))[:LANDMARKS]]
        model = KernelRidge([sets[k] for k in marks])
        at = np.flatnonzero(sure)
        table = model.fit([sets[k] for k in at], label[at], NONE + 1)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        guess = np.argmax(scores(table, starts, np.concatenate(sets)), 1)
        sure = guess == label
    return table


SEGMENT = "struct<first_line: int, last_line: int, lang: string, confidence: float, n_letters: int>"


def detect(df: DataFrame, table: np.ndarray | None, id_col: str = "id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``(id, label, langs, confidence, segments)`` of every row.

    ``label`` is the language the given label names, ``langs`` the languages held in order of their
    letters, ``confidence`` that of the first one, ``segments`` the runs of lines of one language.
    Confidence is the logistic of the lead over the next class, averaged over a run's lines by letters.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(table)  # a fixed size: BUCKETS x classes
    rows = df.select(F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("label"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for whole in batches:
            texts = whole.column(2).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                langs, sure, segments = _detect(table, texts[at:to])
                part = whole.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.list_(pa.string())), pa.array(sure, pa.float32()), pa.array(segments, pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float32()), ("n_letters", pa.int32())])))],
                    names=["id", "label", "langs", "confidence", "segments"],
                )
                at = to

    return rows.mapInArrow(run, f"id {id_type}, label string, langs array<string>, confidence float, segments array<{SEGMENT}>")


def _detect(table, texts: list[str | None]):
    segments: list[list[dict]] = [[] for _ in texts]
    if table is not None:
        lines = Lines(texts)
        score = scores(table, *lines.grams())
        best = np.argmax(score, 1) if len(score) else np.zeros(0, int)
        top = np.sort(score, 1)[:, -2:] if len(score) else np.zeros((0, 2))
        sure = 1 / (1 + np.exp(-4 * (top[:, 1] - top[:, 0])))
        for t, no, lang, conf, n in zip(lines.text.tolist(), lines.line_no.tolist(), best.tolist(), sure.tolist(), lines.letters.tolist()):
            own = segments[t]
            name = LANGUAGES[lang] if lang != NONE else None
            if own and own[-1]["lang"] == name:
                own[-1]["confidence"] += conf * n
                own[-1]["n_letters"] += n
            else:
                if own:
                    own[-1]["last_line"] = no - 1
                own.append({"first_line": no, "last_line": no, "lang": name, "confidence": conf * n, "n_letters": n})
        for t, own in enumerate(segments):
            if own:
                own[-1]["last_line"] = int(lines.last_line[t])
    langs, first = [], []
    for own in segments:
        size: dict[str, int] = {}
        mass: dict[str, float] = {}
        for s in own:
            if s["lang"]:
                size[s["lang"]] = size.get(s["lang"], 0) + s["n_letters"]
                mass[s["lang"]] = mass.get(s["lang"], 0) + s["confidence"]
            s["confidence"] /= s["n_letters"]
        order = sorted(size, key=lambda x: (-size[x], LANGUAGES.index(x)))
        langs.append(order)
        first.append(mass[order[0]] / size[order[0]] if order else None)
    return langs, first, segments
