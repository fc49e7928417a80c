"""Mixing of sources to target shares of all tokens.

Tokens are summed by source; a source's rate is the number of copies of each of its documents that
would fill its share of the mixture, at most its ``max_repeats``. A document comes out floor(rate) times,
and once more if a hash of its id and the seed falls below the fraction: a Bernoulli draw that is the same
in every run and on every cluster. Everything but the table of rates (one row per target) stays in place.

The size of the mixture is ``total_tokens``. By default it is the largest size at which every source that
has documents fills its share, but at least ``least_fill`` (0.5) of the tokens of the targeted sources, so that
one tiny source doesn't shrink the mixture to nothing; a source that can't fill its share then is used as
often as it may be and marked out of reach. With ``least_fill`` 0 all that have documents are within reach.
The size chosen is in the report, beside the share each source may expect and the standard deviation that the
draw gives it, so that a reader can tell chance from a cap.

Source names are compared by their letters and digits, lower-cased, white space and punctuation aside.

Edge cases: a target without documents gets rate 0 and is out of reach; documents of sources without a
target (or of a null source) have share 0 and never come out; texts without tokens come out like any
other of their source but add nothing; targets that repeat a name are one, with their shares added and
the smallest cap; null or negative shares and caps count as 0; an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.tokenise import count_tokens
from lexloom.session import staged

LEAST_FILL = 0.5


def source_key(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, least_fill: float = LEAST_FILL) -> DataFrame:
    """``(key, source, target_share, max_repeats, n_docs, tokens, squares, rate, reachable, mixture_tokens)``, a row per target."""
    wanted = targets.select(source_key(F.col("source")).alias("key"), "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).where("key is not null")
    wanted = wanted.groupBy("key").agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    held = sized.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("squares"))
    both = wanted.join(held, "key", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "squares": F.coalesce("squares", F.lit(0.0))})
    if total_tokens is None:
        reach = F.min(F.when((F.col("target_share") > 0) & (F.col("tokens") * F.col("max_repeats") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share")))
        total_tokens = both.agg(F.greatest(F.coalesce(reach, F.lit(0.0)), F.sum("tokens") * F.lit(float(least_fill)))).first()[0] or 0.0
    total = F.lit(float(total_tokens))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * total / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("rate", rate).withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("target_share") * total * (1 - 1e-9)).withColumn("mixture_tokens", total)


def copies(sized: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """``sized`` with ``copies`` of each document, documents without any left out."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    return sized.join(rates.select("key", "rate"), "key").withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("int")).cast("int")).where("copies > 0")


def mix(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, total_tokens: int | None = None, least_fill: float = LEAST_FILL, seed: int = 17, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(mixture, report)``.

    ``mixture``: ``(id, source, copy, n_tokens)``, a row per use of a document, ``source`` as the targets
    spell it. ``report``: wanted, expected and actual share, tokens, documents and uses of every target;
    ``share_sd`` is the standard deviation of the actual share by the draw.
    """
    counted = count_tokens(df.withColumns({"__id": F.col(id_col), "__key": source_key(F.col(source_col))}), ["__id", "__key"], text_col, path=tokenizer_path)
    sized = staged(counted.toDF("id", "key", "n_tokens").where("key is not null"), "sized")
    rates = staged(plan(sized, targets, total_tokens, least_fill), "rates")
    used = copies(sized, rates, seed)
    mixture = used.join(rates.select("key", "source"), "key").select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")
    got = used.groupBy("key").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("uses"))
    each = rates.join(got, "key", "left").withColumns({"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "uses": F.coalesce("uses", F.lit(0))})
    # One row a target: a control table.
    every = Window.partitionBy(F.lit(1))
    part = F.col("rate") - F.floor("rate")
    each = each.withColumns({"wanted": F.col("rate") * F.col("tokens"), "spread": part * (1 - part) * F.col("squares")})
    each = each.withColumns({"all_tokens": F.sum("mixed_tokens").over(every), "all_wanted": F.sum("wanted").over(every), "all_spread": F.sum("spread").over(every)})
    expected = F.when(F.col("all_wanted") > 0, F.col("wanted") / F.col("all_wanted")).otherwise(0.0)
    # of a ratio of sums, to first order: the source's own draw against that of all others
    sd = F.when(F.col("all_wanted") > 0, F.sqrt((1 - expected) ** 2 * F.col("spread") + expected**2 * (F.col("all_spread") - F.col("spread"))) / F.col("all_wanted")).otherwise(0.0)
    report = each.select(
        "source", "target_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), expected.alias("expected_share"), sd.alias("share_sd"), "max_repeats", "rate", "reachable", "n_docs", "uses", "tokens", "mixed_tokens", "mixture_tokens"
    )
    return mixture, report
