import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality as Q

PROSE = "Where a registry records any request, the board must confirm this review within 20 days. The committee of the site will not release the data unless a guardian agrees to it. "


def kinds(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    return {r["doc_id"]: r for r in Q.text_statistics(df, **kw).collect()}


def test_kinds(spark):
    rng = random.Random(1)
    wrapped = "\n".join(" ".join(PROSE.split()[i : i + 8]) for i in range(0, 30, 8))
    texts = [
        PROSE * 3, wrapped, "- open sample\n- signed clause\n- local board\n- narrow cohort", "open sample\nsigned clause / board\nlocal review board\nnarrow cohort",
        "(a) open sample;\n(b) signed clause;\n(c) local board;\n(d) cohort", "name,size,day\nalpha,12,2024-01-01\nbeta,14,n/a\n,15,x", "│ alpha │ 1 │ yes │\n│ beta │ 2 │ no │\n│ gamma │ 3 │ no │", "alpha one        12    yes\nbeta             13    no\ngamma two               no",
        '"alpha";"12";"yes"\n"beta";"13";"no"\n"gamma";"";"no"', "null " * 40, "Home | Menu | Help | Home | Menu | Top | Help | Home | Menu", "".join(rng.choice("ABCDEFGHijklmnop0123456789+/") for _ in range(300)),
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(40)), "[12.5] WARN 0x9c44 rc=-1\n[13.5] ERR 0x9c45 rc=2\n[14.5] dbg 0x9c46 rc=0", "00000000: 6c 39 55 60 8d 6f 43 b3 38 92\n00000010: 6c 39 55 60 8d 6f 43 b3 38 92",
        "Der Ã¶rtliche Nachweis fÃ¼r die PrÃ¼fung der AntrÃ¤ge wird geprÃ¼ft.", "l�st �� t�xt �� ������ of ��� w�rds ����", "委员会应审查申请。" * 8, "统一的参与者\n地区的记录\n最终的期限\n书面的保障\n最终的协议\n统一的档案\n安全的报告", "short", "", None,
    ]
    want = [None, None, "list", "list", "list", "table", "table", "table", "table", *["junk"] * 8, None, "list", None, None, None]
    got = kinds(spark, texts)
    assert [got[i]["kind"] for i in range(len(texts))] == want


def test_counts_and_ratios(spark):
    r = kinds(spark, ["The cat, the dog.\r\nNo end", None, "", "  \n "])
    assert (r[0]["n_words"], r[0]["word_chars"], r[0]["n_symbols"], r[0]["n_lines"], r[0]["n_ended"], r[0]["n_common"]) == (6, 17, 2, 2, 1, 3)
    assert r[0]["mean_word_length"] == pytest.approx(17 / 6) and r[0]["ended_ratio"] == 0.5
    for k in (1, 2):
        assert r[k]["n_chars"] == 0 and r[k]["mean_word_length"] is None and r[k]["kind"] is None
    assert r[3]["n_chars"] == 4 and r[3]["n_words"] == 0
    assert kinds(spark, []) == {}


@pytest.mark.parametrize("size", [50, 300])
def test_chunks_add_up(spark, size):
    rng = random.Random(2)
    wrapped = "\n".join(" ".join(PROSE.split()[i : i + 8]) for i in range(0, 30, 8))
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(5, 40)):
            parts.append(rng.choice([PROSE, wrapped, "- item\n- other item\n- third\n- fourth\n", "a,1,2\nb,3,4\nc,5,6\nd,7,8\n", "x" * rng.randint(1, 900), "wörter und mehr ", "\r\n", "\n\n", "\n \t\r\n\n", "委员会应审查申请。", "データの共有は"]))
            parts.append(rng.choice(["", "\n\n", "\r\n\r\n", "\r\r"]))
        texts.append("".join(parts))
    cuts = [Q.chunks(t, size) for t in texts]
    assert ["".join(c) for c in cuts] == texts and sum(map(len, cuts)) > 150
    whole, cut = kinds(spark, texts, chunk=10**9), kinds(spark, texts, chunk=size)
    assert [[whole[i][c] for c in Q.COUNTS] for i in whole] == [[cut[i][c] for c in Q.COUNTS] for i in whole]


def test_one_large_document_is_spread(spark):
    text = "\n\n".join(f"{PROSE}\n- item {i}\n- other\n- third\n\nThe list ends here." for i in range(3000))
    parts = Q.chunks(text, 5000)
    assert max(map(len, parts)) < 6000 and len(parts) > 50
    spread = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    tasks = Q.count_rows(spread, "doc_id", "text", 5000).select(F.spark_partition_id()).distinct().count()
    assert tasks > 1 and Q.text_statistics(spread, chunk=5000).drop("kind").first() == Q.text_statistics(spread, chunk=10**9).drop("kind").first()


def test_east_asian_words():
    n = dict(zip(Q.COUNTS, Q.count_text("委员会的审查 data2 データの共有は 동의 및 철회")))
    assert n["n_words"] == 6 + 1 + 5 + 3 and n["n_common"] == 6  # 会 的, の 有 は, 및


def test_runs_are_judged_across_chunks(spark):
    text = "\n".join(f"- item {chr(97 + i % 26)} of the box" for i in range(400))
    whole, cut = kinds(spark, [text], chunk=10**6)[0], kinds(spark, [text], chunk=100)[0]
    assert whole["kind"] == cut["kind"] == "list" and cut["list_chars"] == whole["list_chars"] == len(text)
    assert cut["n_lines"] == whole["n_lines"] and cut["n_ended"] == whole["n_ended"]


def test_long_blocks_are_judged_whole(spark):
    words = ("where a registry records any request the board must confirm this review and the committee of the site will release data " * 60).split()
    lines = [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    wrapped = "\n".join(["The board has met on this day to review all of it."] + lines)  # the only sentence end is in the first line
    one_line = "a,b " + PROSE * 30 + "\n- item\n- other item\n- third\n- fourth\n"
    whole, cut = kinds(spark, [wrapped, one_line], chunk=10**6), kinds(spark, [wrapped, one_line], chunk=700)
    assert [[whole[i][c] for c in Q.COUNTS] for i in whole] == [[cut[i][c] for c in Q.COUNTS] for i in whole]
    assert cut[0]["kind"] is None and cut[0]["list_chars"] == 0
