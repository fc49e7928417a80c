"""Per-document text statistics, and documents that are lists, tables or junk instead of prose.

A text of more than ``chunk`` code points is cut into chunks, which are spread over tasks by (id, chunk number);
shorter ones are counted where they lie, without a shuffle. Counts of chunks add up (partial sums by task, then by
id), and ratios and rules come from the sums. So that the sums are exactly those of the whole text, a chunk ends
only where nothing of the way lines are judged reaches across: behind blank lines that follow a line which
ends any table or list (a long one, a sentence, or junk). That is the boundary state: it is empty there, for words, blocks,
tables and lists alike. A stretch without such a place stays one chunk, however long.

Lines are judged as follows. Junk: replacement characters, text decoded with the wrong encoding, mostly
symbols, long unbroken strings, single scattered characters, log lines, menus, the same words over and
over, letters without the vowels of words, many words without a sentence and without common words. Table:
three or more lines in a row with the same separators. List: three or more lines in a row that are short
and no sentences, unless they are wrapped prose.

Words are runs of letters and digits; as Chinese and Japanese don't part words by spaces, each ideograph and each
run of hiragana or of katakana is one.

Edge cases: null and empty texts have zero counts, null ratios and no kind; blank lines count with the
line before them; figures of rows that repeat an id add up; an empty table gives an empty table; other columns
are ignored; equal texts get equal figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 50_000
MIN_CHARS = 40
ITEM, RUN = 100, 3

# Frequent function words of the languages of the tables.
COMMON = frozenset(
    """
    the of and to in a is that for it as with on by be this an are or from at not which was has have its their our your we you they
    when where if may must shall will no any each all does do can both
    der die das den dem des ein eine einer eines einem einen und oder nicht mit von zu im in auf für ist sind wird werden nach bei aus sich dass als an sondern
    le la les de des du un une et ou dans en pour par sur avec que qui ne pas est sont au aux ce cette selon
    el los las del y o en con por para que no se su al es son según una unos ante desde
    os das dos da do e um uma em com não se ao na no nos pelo pela são já
    的 是 在 和 了 有 不 与 與 及 或 为 為 等 应 應 可 将 將 对 對 以 中 其 于 於 由 并 並 该 該 您 我 们 們 这 這 会 會 被
    の に は を が と で も から まで より です ます する した して される している いる ある こと ため この その また および または について による における としては
    및 또는 그 이 수 있는 있습니다 합니다 하는 대한 위한 등 것 때 경우 모든 그리고 본 각 할 한 후 이를 통해 대해 따라 위해 없이 않습니다
    """.split()
)
WORD = re.compile(r"[^\W_]+")
EAST = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
EAST_WORD = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]|[\u3040-\u309f]+|[\u30a0-\u30ff]+|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？]")
LINE_END = re.compile(r"[.!?…。！？:;：；][\"'”’»)\]」』）]*$")
BULLET = re.compile(r"(?:[-–—*•◦▪·‣☐☑✓o+]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
WRONG_CODE = re.compile(r"[\x80-\x9f]|[ÃÂ][\x80-\xbf]|[ÃÂâãäåæçèéìíêë][¡-¿€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]")
LOG = re.compile(r"\b0x[0-9a-fA-F]{3,}\b|(?:^|\s)\w+=-?\w+(?:\s|$)")
VOWELS = "aeiouàâäáãåéèêëíîïìóôöòõúùûüæ".encode("latin-1")
NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha())
BORDER = frozenset("+-|=:─│┼┌┐└┘├┤┬┴━ \t")
GAP = re.compile(r"\S(?: {3,}|\t)\S")
BREAK = re.compile(r"\r\n|\r|\n")
#: The end of a line and the blank lines behind it.
BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")

PROSE, JUNK, TABLE, LIST, BLANK = range(5)


def is_junk(s: str) -> bool:
    """Whether a stripped line says nothing readable."""
    n = len(s)
    if s.count("�") > 0.04 * n:
        return True
    if not s.isascii():
        wrong = len(WRONG_CODE.findall(s))
        if wrong >= 2 and wrong > 0.008 * n:
            return True
    if n < 12:
        return False
    tokens = s.split()
    if sum(len(t) for t in tokens if len(t) >= 30 and t.isascii() and t.count(",") + t.count(";") < 2) > 0.5 * n:
        return True
    words = WORD.findall(s.lower())
    letters = sum(map(len, words))
    spaces = n - sum(map(len, tokens))
    symbols = n - spaces - letters
    if symbols > 0.45 * (n - spaces) and "│" not in s and not BORDER.issuperset(s) and (letters < 0.2 * (n - spaces) or not GAP.search(s)):
        fields = s.count("|") + s.count('"') + s.count(";") + s.count(",") if "|" in s or '";"' in s or '","' in s else 0
        if symbols - fields > 0.45 * (n - spaces):
            return True
    plain = [t for t in tokens if t not in ("|", "│", "-")]
    if len(plain) >= 6:
        short = [len(t) for t in plain if len(t) <= 2]
        if (short.count(1) > 0.6 * len(plain) or len(short) > 0.75 * len(plain)) and not CJK.search(s):
            return True
    if (s[0] in "[(" or s[0].isdigit()) and len(tokens) < 40 and LOG.search(s):
        return True
    if s.count("|") >= 7:
        fields = [f.strip() for f in s.split("|") if f.strip()]
        if len(set(fields)) <= 0.75 * len(fields):
            return True
    if len(words) >= 12 and len(set(words)) <= 0.25 * len(words):
        return True
    if GAP.search(s):
        return False
    plain_bytes = s.lower().encode("latin-1", "replace")
    latin = len(plain_bytes.translate(None, NO_LETTERS))
    if latin >= 30 and latin > 0.6 * letters and latin - len(plain_bytes.translate(None, NO_LETTERS + VOWELS)) < 0.28 * latin:
        return True
    if len(words) >= 25 and latin > 0.6 * letters and not SENTENCE_END.search(s):
        common = sum(w in COMMON for w in words)
        if common < 0.08 * len(words) and s.count(",") + s.count("|") < 0.12 * len(words):
            return True
    return False


def separators(line: str) -> tuple[str, int] | None:
    """What separates a line's fields, and how often; None for text."""
    for d in "|│\t":
        if d in line:
            return d, line.strip().strip("|│").count(d) if d != "\t" else line.count(d)
    if GAP.search(line):
        return " ", 1
    for d in ",;":
        k = line.count(d)
        if k == 1 and d == ";" and line.rstrip()[-1] == d:
            continue  # an item's end
        if k >= 1 and k - line.count(d + " ") >= max(1, 0.7 * k):
            return d, k
    return None


def _sentence(s: str) -> bool:
    return bool(SENTENCE_END.search(s))


def judge(lines: list[str]) -> list[int]:
    """Kind of each line of a text."""
    kind = [PROSE] * len(lines)
    bare = [x.strip() for x in lines]
    full = [k for k, s in enumerate(bare) if s]
    for k, s in enumerate(bare):
        if not s:
            kind[k] = BLANK
        elif is_junk(s):
            kind[k] = JUNK
    # tables: runs of equal separators; borders go with them
    run: list[int] = []
    held = None

    def close() -> None:
        rows = [k for k in run if not BORDER.issuperset(bare[k])]
        if len(rows) >= RUN and not (held and held[0] in ",;" and sum(_sentence(bare[k]) for k in rows) > 0.3 * len(rows)):
            if held and (held[1] >= 2 or held[0] in "|│\t " or len(rows) >= 4):
                for k in run:
                    kind[k] = TABLE

    for k in full:
        if kind[k] == JUNK:
            close()
            run, held = [], None
            continue
        if len(bare[k]) >= 5 and BORDER.issuperset(bare[k]):
            run.append(k)
            continue
        own = separators(lines[k])
        if own is not None and held is not None and (own == held or (own[0] == held[0] and own[0] == " ")):
            run.append(k)
        else:
            close()
            run, held = ([*run, k] if held is None and run else [k], own) if own else ([], None)
    close()
    # lists: runs of short lines that are no sentences
    block = [0] * len(lines)
    for k in range(1, len(lines)):
        block[k] = block[k - 1] + (not bare[k])
    width: dict[int, int] = {}
    size: dict[int, int] = {}
    for k in full:
        width[block[k]] = max(width.get(block[k], 0), len(bare[k]))
        size[block[k]] = size.get(block[k], 0) + 1
    # lines filled up to their block's width run on in the next line, if the block has sentences
    spoken = {block[k] for k in full if _sentence(bare[k])}
    wrapped = [False] * len(lines)
    for k in full:
        if k + 1 < len(lines) and bare[k + 1] and block[k] in spoken and len(bare[k]) >= max(38, 0.72 * width[block[k]]) and not BULLET.match(bare[k + 1]):
            wrapped[k] = wrapped[k + 1] = True
    run = []

    def close_list() -> None:
        if len(run) < RUN:
            return
        marked = sum(bool(BULLET.match(bare[k])) for k in run)
        if marked < 0.5 * len(run):
            inner = [k for k in run if k + 1 < len(lines) and bare[k + 1]]  # lines that another follows at once
            if len(inner) >= 2 and size[block[inner[0]]] > 2:
                near = max(width[block[k]] for k in inner)
                filled = sum(len(bare[k]) >= 0.72 * near for k in inner) / len(inner)
                if filled >= 0.85 and near >= (18 if CJK.search(bare[inner[0]]) else 38):
                    text = " ".join(bare[k] for k in run)
                    if is_junk(text):
                        for k in run:
                            kind[k] = JUNK
                    return
        for k in run:
            kind[k] = LIST

    for k in full:
        s = bare[k]
        m = BULLET.match(s)
        item = s[m.end() :] if m else s
        if kind[k] == PROSE and not wrapped[k] and len(s) <= ITEM and not _sentence(item):
            run.append(k)
        else:
            close_list()
            run = []
    close_list()
    return kind


COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_ended", "n_common", "list_chars", "table_chars", "junk_chars"]


def count_text(text: str) -> list[int]:
    """The counts of ``COUNTS`` of a whole text or of a chunk of ``chunks``."""
    low = text.lower()
    words = (EAST_WORD if EAST.search(low) else WORD).findall(low)
    chars = sum(map(len, words))
    spaces = len(text) - sum(map(len, text.split()))
    lines, ends, at = [], [], 0
    for m in BREAK.finditer(text):
        lines.append(text[at : m.start()])
        at = m.end()
        ends.append(at)
    lines.append(text[at:])
    ends.append(len(text))
    size = [0] * 5
    last = PROSE
    ended = filled = at = 0
    for line, end, kind in zip(lines, ends, judge(lines)):
        if kind == BLANK:
            kind = last
        else:
            filled += 1
            ended += bool(LINE_END.search(line.rstrip()))
        last = kind
        size[kind] += end - at
        at = end
    return [len(text), len(words), chars, len(text) - spaces - chars, filled, ended, sum(w in COMMON for w in words), size[LIST], size[TABLE], size[JUNK]]


def _settled(line: str) -> bool:
    """Whether no table and no list goes on behind this line, whatever was before it."""
    s = line.strip()
    if not s:
        return False
    if is_junk(s):
        return True
    if separators(line) is not None or (len(s) >= 5 and BORDER.issuperset(s)):
        return False
    m = BULLET.match(s)
    return len(s) > ITEM or _sentence(s[m.end() :] if m else s)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in chunks of at least ``size`` code points (but the last), cut where ``count_text`` adds up."""
    out, begin = [], 0
    while len(text) - begin > size:
        at = begin + size
        end = None
        for m in BLANK_LINES.finditer(text, at):
            start = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
            if m.end() < len(text) and start >= begin and _settled(text[start : m.start()]):
                end = m.end()
                break
        if end is None:
            break
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def count_rows(df: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """``(id, counts...)`` of every row's text, or of every chunk of it."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = [count_text(x) for x in batch.column(1).to_pylist()]
                cols = list(zip(*got)) if got else [[] for _ in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *COUNTS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = chunks(text, chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(parts))), pa.array(parts), pa.array(range(len(parts)), pa.int32())], names=["id", "text", "no"])

    counts = f"id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    small = rows.where(F.length("text") <= chunk).mapInArrow(count, counts)
    large = rows.where(F.length("text") > chunk).mapInArrow(cut, f"id {id_type}, text string, no int")
    # A stated number of partitions, as merging them by bytes would put a large document's chunks into one task again.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.union(large.repartition(tasks, "id", "no").select("id", "text").mapInArrow(count, counts))


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = CHUNK) -> DataFrame:
    """Counts, ratios and ``kind`` (list, table, junk or null) of every row's text."""
    summed = count_rows(df, id_col, text_col, chunk).groupBy("id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    half = lambda c: (F.col("n_chars") >= MIN_CHARS) & (2 * F.col(c) > F.col("n_chars"))
    return summed.select(
        F.col("id").alias(id_col), *COUNTS,
        ratio("word_chars", "n_words").alias("mean_word_length"), ratio("n_symbols", "n_chars").alias("symbol_ratio"),
        ratio("n_ended", "n_lines").alias("ended_ratio"), ratio("n_common", "n_words").alias("common_ratio"),
        F.when(half("list_chars"), "list").when(half("table_chars"), "table").when(half("junk_chars"), "junk").alias("kind"),
    )
