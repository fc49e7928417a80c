import random
import re

import pytest

from lexloom.llm import chunk_split as C

STRETCH = r"[^\s。！？；，、]{%d,}"


def check(text, pieces, size, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert s < s2 and e < e2 and e - s2 <= overlap
        assert s2 <= e or not text[e:s2].strip()
    for s, e, _ in pieces:
        assert 0 < e - s <= size and not text[s].isspace() and not text[e - 1].isspace()


def test_random_texts_are_covered_and_forced_only_where_needed():
    rng = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append("".join(rng.choice("ab。，、  \n.!é́🙂") for _ in range(rng.randint(0, 120))))
            parts.append(rng.choice("xyz") * rng.choice([1, 20, 139, 140, 141, 300, 500]))
        text = C.normalise("".join(parts))
        if text:
            for size, overlap in ((140, 30), (140, 0), (300, 50)):
                pieces = C.split(text, size, overlap)
                check(text, pieces, size, overlap)
                assert any(k == C.FORCED for _, _, k in pieces) == bool(re.search(STRETCH % (size + 1), text))


def test_exact_limits():
    assert C.split("") == [] and C.split("a" * 900) == [(0, 900, C.END)]
    two = C.split("a" * 900 + " " + "b" * 900)
    assert [(s, e) for s, e, _ in two] == [(0, 900), (901, 1801)]
    assert any(k == C.FORCED for *_, k in C.split("a" * 901))
    marked = C.split("字" * 900 + "。" + "字" * 900)
    assert not any(k == C.FORCED for *_, k in marked)


def test_forced_pieces_share_the_whole_overlap():
    pieces = C.split("x" * 5000)
    assert all(e - s2 == 150 for (_, e, _), (s2, _, _) in zip(pieces, pieces[1:]))


def test_sentences_before_words_and_even_pieces():
    text = " ".join(f"Sentence number {i} says something of a certain length here." for i in range(40))
    pieces = C.split(text)
    assert all(k in (C.SENTENCE, C.END) for *_, k in pieces)
    assert all(text[s2 - 2] == "." and text[s2].isupper() for _, (s2, _, _) in zip(pieces, pieces[1:]))
    sizes = [e - s for s, e, _ in pieces]
    assert max(sizes) - min(sizes) < 200


def test_marks_stay_with_their_base():
    for s, e, _ in C.split("é" * 1500):
        assert e == 3000 or e % 2 == 0


def test_long_text_is_whole():
    text = "word " * 60_000
    pieces = C.split(C.normalise(text))
    check(C.normalise(text), pieces, 900, 150)


def test_wide_gap_beside_a_long_stretch():
    for wide in (60, 100, 400):
        for n in range(780, 901, 5):
            for lead in ("foo. b", "foo. b " * 130):
                text = C.normalise(lead + " " * wide + "x" * n + " and further words" * 20)
                pieces = C.split(text)
                check(text, pieces, 900, 150)
                assert not any(k == C.FORCED for *_, k in pieces)


def test_stretches_without_a_place_between_units():
    for text in ("a" + "\u0301" * 3000, "\u0301" * 901, "\U0001f468\u200d" * 1200, "a" * 880 + "\u0301" * 800 + "b" * 50, "。" + "」" * 900 + " end"):
        for size, overlap in ((900, 150), (900, 0), (140, 30), (20, 5), (1, 0)):
            pieces = C.split(text, size, overlap)
            assert all(0 < e - s <= size for s, e, _ in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
            assert all(s < s2 <= e or not text[e:s2].strip() for (s, e, _), (s2, _, _) in zip(pieces, pieces[1:]))
    assert not any(k == C.FORCED for *_, k in C.split("。" + "」" * 900 + " end"))


def test_table(spark):
    df = spark.createDataFrame([("a", "x " * 600, 3, "clash"), ("a", "x " * 600, 3, "clash"), ("b", None, None, None), ("c", " \r\n ", 1, None), ("d", "short\r\ntext", 0, None), (None, "n", 0, None)], "id string, text string, page int, start string")
    rows = C.split_records(df).collect()
    assert {(r["id"], r["n_pieces"]) for r in rows} == {("a", 2), ("d", 1), (None, 1)}
    assert [r["text"] for r in rows if r["id"] == "d"] == ["short\ntext"] and all(r["page"] == 3 for r in rows if r["id"] == "a")
    assert {r["id"] for r in C.split_records(df, only_oversized=True).collect()} == {"a"}
    assert C.split_records(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.split_records(df, size=100, overlap=100)


def test_a_finer_grid_never_costs_more():
    rng = random.Random(4)
    for _ in range(20):
        text = C.normalise(" ".join("".join(rng.choice("abc,.") for _ in range(rng.randint(1, 30))) + rng.choice(["", "", "\n", "\n\n"]) for _ in range(200)))
        fine, usual = (C.cheapest(text, 300, 50, g) for g in (1, 30))
        check(text, fine[0], 300, 50)
        assert fine[1] <= usual[1] + 1e-9
