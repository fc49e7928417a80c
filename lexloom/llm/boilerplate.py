"""Lines repeated across one source's documents, and texts without them.

Lines end at CR LF, CR or LF and are numbered from 0 over all lines of the
stored text. A line's key is its letters in order, lower-cased; keys of fewer
than ``min_letters`` letters never count. A node of a source's graph is a key,
weighted by the number of distinct documents that hold it; an edge joins two
keys that follow each other (lines without a key between them are passed over),
weighted alike. Nodes and edges of high support are kept, and the connected
components of what is kept are the boilerplate blocks. Every occurrence of a
block's line is deleted.

High support is at least ``min_docs`` documents and at least ``min_share`` of
the source's documents. So a source with D documents keeps at most
L / ``min_share`` nodes, L being its mean number of distinct lines a document:
a bound that does not grow with D, which is why one source's kept graph may be
handled by one task.

Keys are compared by their 64-bit hash together with the source. Texts are read once: the keys and places of all lines
are written as a table, from which nodes, edges and occurrences come.

What is deleted is decided by the support of lines alone: every kept node is in a block, if only its own, so a
repeated line goes also where it stands apart from the lines that usually surround it. Edges only say which lines belong
to one block; a stricter rule (delete a line only beside its block's others) would leave single lines that are boilerplate
by the definition above.

Edge cases: rows with a null id are left out; rows that repeat an id are one record; a null source is no source,
its records have no repeated lines; records with a null document count towards
nothing but their lines are reported; null and empty texts have no lines; an
empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import staged

LINE_END = "\r\n|\r|\n"
FEW_NODES = 2_000_000


def line_keys(text: Column, min_letters: int) -> Column:
    """Array of ``(line_no, key)`` of the lines with enough letters."""
    lines = F.split(text, LINE_END, -1)
    keyed = F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), F.lower(F.regexp_replace(line, r"\P{L}+", "")).alias("key")))
    return F.filter(keyed, lambda x: F.length(x["key"]) >= min_letters)


def occurrences(df: DataFrame, id_col: str, text_col: str, source_col: str, doc_col: str, min_letters: int) -> DataFrame:
    """``(id, source, doc, seq, line_no, node)``: one row per line with a key; repeated records stay repeated."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(doc_col).alias("doc"), F.col(doc_col).isNotNull().alias("has_doc"), F.col(text_col).alias("text")).where("id is not null and source is not null and text is not null")
    return rows.select("id", "source", F.when(F.col("has_doc"), F.col("doc")).alias("doc"), F.posexplode(line_keys(F.col("text"), min_letters)).alias("seq", "line")).select(
        "id", "source", "doc", "seq", F.col("line.line_no").alias("line_no"), F.xxhash64("line.key").alias("node")
    )


def _supported(counted: DataFrame, keys: list[str], documents: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    support = counted.where("doc is not null").groupBy(*keys).agg(F.countDistinct("doc").alias("support")).where(F.col("support") >= min_docs)
    return support.join(documents, "source").where(F.col("support") >= F.col("n_docs") * min_share - 1e-9).drop("n_docs")


def find_blocks(df: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "source", doc_col: str = "document_id", *, min_docs: int = 4, min_share: float = 0.05, min_letters: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(blocks, found)``.

    ``blocks``: ``(source, node, support, block)``, a row per repeated line, ``block`` being the
    smallest node of its component. ``found``: ``(id, line_no, source, block)``, a row per occurrence.
    """
    documents = df.where(f"{source_col} is not null and {doc_col} is not null").groupBy(F.col(source_col).alias("source")).agg(F.countDistinct(doc_col).alias("n_docs"))
    lines = staged(occurrences(df, id_col, text_col, source_col, doc_col, min_letters), "lines")
    nodes = _supported(lines, ["source", "node"], documents, min_docs, min_share)
    marked = lines.join(nodes.drop("support"), ["source", "node"]).groupBy("id", "line_no").agg(*(F.first(c).alias(c) for c in ("source", "doc", "seq", "node")))
    order = Window.partitionBy("id").orderBy("seq")
    follow = marked.withColumns({"next_node": F.lead("node").over(order), "next_seq": F.lead("seq").over(order)}).where("next_seq = seq + 1 and next_node <> node")
    edges = _supported(follow.select("source", F.least("node", "next_node").alias("a"), F.greatest("node", "next_node").alias("b"), "doc"), ["source", "a", "b"], documents, min_docs, min_share)
    graph = nodes.select("source", F.col("node").alias("a"), F.col("node").alias("b"), "support").unionByName(edges.select("source", "a", "b", F.lit(None).cast("bigint").alias("support")))

    def components(pdf):
        import pandas as pd

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        own = pdf[pdf["support"].notna()]
        return pd.DataFrame({"source": own["source"], "node": own["a"], "support": own["support"].astype("int64"), "block": [root(x) for x in own["a"].tolist()]})

    blocks = graph.groupBy("source").applyInPandas(components, "source string, node bigint, support bigint, block bigint")
    found = marked.join(blocks.select("source", "node", "block"), ["source", "node"]).select("id", "line_no", "source", "block")
    return blocks, found


def remove_blocks(df: DataFrame, blocks: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "source", *, min_letters: int = 3) -> DataFrame:
    """``(id, text, n_removed)`` of every row: the text without its source's block lines.

    Rows that repeat an id, or have none, come out as they came in: whoever wants one row an id drops the others
    before, by ids alone, so that no text is shuffled. Other lines keep their content; the line ends of what is left become LF where a line went, and
    stay as they are in texts that lose none. Null texts stay null. Where all blocks together hold at most ``FEW_NODES``
    lines (16 MB), they are sent to the texts; else texts are joined by source, and hot sources are left to the
    skew handling of the join.
    """
    blocks = staged(blocks.select("source", "node"), "blocks")
    wanted = blocks.groupBy("source").agg(F.collect_set("node").alias("nodes"))
    if blocks.count() <= FEW_NODES:
        wanted = F.broadcast(wanted)
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    key = lambda line: F.lower(F.regexp_replace(line, r"\P{L}+", ""))
    kept = F.filter(F.split("text", LINE_END, -1), lambda line: ~((F.length(key(line)) >= min_letters) & F.array_contains("nodes", F.xxhash64(key(line)))))
    joined = rows.join(wanted, "source", "left").withColumn("kept", F.when(F.col("nodes").isNotNull(), kept))
    removed = F.coalesce(F.size(F.split("text", LINE_END, -1)) - F.size("kept"), F.lit(0))
    return joined.select("id", F.when(F.col("kept").isNotNull() & (removed > 0), F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"), F.when(F.col("kept").isNotNull(), removed).otherwise(0).alias("n_removed"))
