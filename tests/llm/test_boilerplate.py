import random
import re

from lexloom.llm import boilerplate as B

SCHEMA = "id string, text string, source string, document_id string, node string"


def brute(rows, min_docs=4, share=0.05):
    docs, held = {}, {}
    unique = {i: (t, s, d) for i, t, s, d in rows if i is not None}
    for t, s, d in unique.values():
        if s is not None and d is not None:
            docs.setdefault(s, set()).add(d)
    lines = [(i, n, s, d, "".join(c for c in x if c.isalpha()).lower()) for i, (t, s, d) in unique.items() if t is not None and s is not None for n, x in enumerate(re.split("\r\n|\r|\n", t))]
    for _, _, s, d, k in lines:
        if len(k) >= 3 and d is not None:
            held.setdefault((s, k), set()).add(d)
    ok = {k for k, v in held.items() if len(v) >= min_docs and len(v) >= share * len(docs[k[0]]) - 1e-9}
    return {(i, n) for i, n, s, _, k in lines if (s, k) in ok}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def sample(rng, n=300):
    feet = ["© 2024 All rights reserved", "Share this page: X (12)", "Printed copies are uncontrolled", "a 1"]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "b.txt", "c.txt", None])
        lines = [f"own line {rng.random()}" + chr(97 + i % 26) * (i % 40) for _ in range(rng.randint(0, 4))]
        for f in feet:
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), f.upper() if rng.random() < 0.3 else f.replace("12", str(i)))
        rows.append((f"r{i}", rng.choice(["\n", "\r\n", "\r"]).join(lines), source, rng.choice([None, f"d{rng.randint(0, 30)}"])))
    return rows + rows[:5] + [("nul", None, "hot", "d1"), ("emp", "", "hot", "d1"), (None, "Printed copies are uncontrolled", "hot", "d2")]


def test_equals_brute_force(spark):
    rows = sample(random.Random(1))
    blocks, found = B.find_blocks(frame(spark, rows))
    got = [(r["id"], r["line_no"]) for r in found.collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and got
    assert {r["source"] for r in blocks.collect()} <= {"hot", "b.txt", "c.txt"}


def test_blocks_join_consecutive_lines(spark):
    rows = [(f"r{i}", f"own {i}\nHeader one\n\nHeader two\nbody {'x' * i}\nFooter", "s", f"d{i}") for i in range(6)]
    blocks = {r["support"]: 0 for r in B.find_blocks(frame(spark, rows))[0].collect()}
    assert blocks == {6: 0}
    by = {}
    for r in B.find_blocks(frame(spark, rows))[1].where("id = 'r3'").collect():
        by[r["line_no"]] = r["block"]
    assert set(by) == {0, 1, 3, 5} and by[0] == by[1] == by[3] != by[5]


def test_cleaned_texts(spark):
    rows = [(f"r{i}", f"Only here {'abcdefgh'[i] * 5}\r\nFooter line", "s", f"d{i}") for i in range(5)] + [("n", None, "s", "d9"), ("k", "keep\r\nthis", "t", "d")]
    df = frame(spark, rows)
    got = {r["id"]: (r["text"], r["n_removed"]) for r in B.remove_blocks(df, B.find_blocks(df)[0]).collect()}
    assert got["r0"] == ("Only here aaaaa", 1) and got["n"] == (None, 0) and got["k"] == ("keep\r\nthis", 0)


def test_limits(spark):
    three = [(f"r{i}", "Same line", "s", f"d{i}") for i in range(3)]
    assert B.find_blocks(frame(spark, three))[1].count() == 0
    four = [*three, ("r3", "same LINE 7", "s", "d3"), ("r4", "Same line", "s", None)]
    assert B.find_blocks(frame(spark, four))[1].count() == 5
    assert B.find_blocks(frame(spark, []))[1].count() == 0
    many = [(f"q{i}", "z" * (i + 3), "s", f"e{i}") for i in range(90)]
    assert B.find_blocks(frame(spark, four + many))[1].count() == 0  # 4 of 94 documents are below 5 %
