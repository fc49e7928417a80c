import base64
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from lexloom.llm import mixing, tokenise  # noqa: E402


def reference(name="byte_bpe_50k"):
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    rng = random.Random(0)
    letters = "  \t\n\r\x0b\xa0　'sStTrevmld0129²½ⅣaAéßжع漢かカ한🙂‍́.,!?-_<|>\x00\x1c\x85İ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "'s", "''s", " 's", "\n's", "a'sure", "'re've'll", "x  'd", "<|endoftext|>", "a" * 500, "\0\0", "漢字" * 300, "The quick brown fox. " * 2000]


def test_equals_the_public_encoder():
    enc = reference()
    replay = tokenise.MergeReplay(tokenise.tokenizer_path("byte_bpe_50k"))
    rows = texts(4000)
    got, counts = replay.encode(rows)
    at = 0
    for t, n in zip(rows, counts.tolist()):
        assert [x for w in got[at : at + n] for x in w] == enc.encode_ordinary(t), repr(t[:60])
        at += n
    back = replay.encode(rows)
    assert back[0] == got


def test_word_table_may_be_emptied(monkeypatch):
    enc = reference()
    monkeypatch.setattr(tokenise, "WORD_TABLE", 10)
    replay = tokenise.MergeReplay(tokenise.tokenizer_path("byte_bpe_50k"))
    for _ in range(2):
        for t in texts(30):
            got, _ = replay.encode([t])
            assert [x for w in got for x in w] == enc.encode_ordinary(t)


def test_table_and_round_trip(spark):
    enc = reference()
    rows = [(1, "hello world", "clash"), (2, None, None), (3, "", None), (4, "hello world", None), (5, "<|endoftext|>", None), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokenise.encode_corpus(df).collect()]
    want = {i: enc.encode_ordinary(t or "") for i, t, _ in rows}
    assert len(got) == 6 and dict(got) == want and enc.decode(dict(got)[1]) == "hello world"
    assert {r["doc_id"]: r["n_tokens"] for r in tokenise.count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}
    assert tokenise.encode_corpus(df.limit(0)).count() == 0
    other = tokenise.encode_corpus(df, tokenizer="byte_bpe_multi_50k").where("doc_id = 1").first()["ids"]
    assert other == reference("byte_bpe_multi_50k").encode_ordinary("hello world")


DOCS = "doc_id bigint, text string, source string, rate string"


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(d, t, **kw)
    return mixture, {r["source"]: r for r in report.collect()}


def test_shares_caps_and_spelling(spark):
    docs = [(i, "a b c d", "Big Source") for i in range(2000)] + [(5000 + i, "a b c d", ["small-source", "SMALL SOURCE "][i % 2]) for i in range(300)] + [(9000, "x", None), (9001, "x", "Unlisted"), (9002, None, "Big Source")]
    targets = [("Big Source", 0.5, 2), ("Small Source", 0.4, 4), ("Nobody", 0.1, 2)]
    mixture, report = mixed(spark, docs, targets)
    rows = mixture.collect()
    per = {}
    for r in rows:
        per.setdefault((r["source"], r["id"]), []).append(r["copy"])
    assert max(len(v) for (s, _), v in per.items() if s == "Small Source") <= 4 and all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    assert not {r["id"] for r in rows} & {9000, 9001}
    assert not report["Nobody"]["reachable"] and report["Nobody"]["actual_share"] == 0
    assert abs(report["Big Source"]["actual_share"] / report["Small Source"]["actual_share"] - 1.25) < 0.1
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed(spark, docs, targets)[0].collect()))


def test_out_of_reach_is_capped(spark):
    docs = [(i, "a b c d", "big") for i in range(100)] + [(500, "a b c d", "tiny")]
    _, report = mixed(spark, docs, [("big", 0.5, 1), ("tiny", 0.5, 3)], total_tokens=200)
    assert report["tiny"]["rate"] == 3 and not report["tiny"]["reachable"] and report["tiny"]["uses"] == 3


def test_empty_mixture(spark):
    mixture, report = mixed(spark, [], [("a", 1.0, 2), ("A ", None, None), (None, 0.5, 1)])
    assert mixture.count() == 0 and len(report) == 1 and report["A "]["actual_share"] == 0
