import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import lang_id as L

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en_US", "en"), (" German ", "de"), ("fre", "fr"), ("zh-Hans", "zh"), ("und", None), ("", None), (None, None), ("english", "en"), ("nl", None), ("??", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(L.label_language(F.col("x"))).first()[0] == code


def test_lines_and_distinct_grams():
    lines = L.Lines(["short\r\n" + "Abc def " * 5 + "\r\nend", None, "x" * 25], 20)
    assert lines.line_no.tolist() == [1, 0] and lines.text.tolist() == [0, 2]
    starts, gram = lines.grams()
    one, two = gram[: starts[1]], gram[starts[1] :]
    assert len(set(one.tolist())) == len(one) and len(two) == 6  # x, xx, xxx, and the same before the line's end


def test_folded_table_equals_kernel_scores():
    rng = np.random.default_rng(1)
    texts = ["the cat sat on the mat and slept", "der hund lief durch den wald nach haus", "le chat dort sur le tapis rouge ici", "a man walked along the river bank"]
    sets = L._sets(texts)
    model = L.KernelRidge(sets[:3])
    table = model.fit(sets, np.array([0, 1, 2, 0]), 3)
    k = np.array([[len(set(x) & set(y)) / np.sqrt(len(x) * len(y)) for y in sets[:3]] for x in sets])
    assert np.allclose(model.kernel(sets), k, atol=1e-5)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    assert np.argmax(L.scores(table, starts, np.concatenate(sets)), 1).tolist() == [0, 1, 2, 0]
    assert rng is not None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy_and_segments(spark):
    chunks = spark.read.parquet(f"{DATA}/../sf0.01/chunks.parquet")
    table = L.fit(chunks)
    rows = [
        ("de", "Der Ausschuss prüft den Antrag und meldet das Ergebnis der zuständigen Stelle."),
        ("fr", "La commission examine la demande et communique le résultat au responsable du registre."),
        ("es", "La comisión revisa la solicitud y comunica el resultado al responsable del registro."),
        ("en", "The committee reviews the request and reports the result to the office in charge."),
        ("zh", "委员会应审查申请并将结果通知负责登记的机构，书面方案由独立的监护人保存。"),
        ("ja", "委員会は申請を審査し、その結果を登録の担当者に書面で通知しなければならない。"),
        ("ko", "위원회는 신청을 심사하고 그 결과를 등록 담당자에게 서면으로 통지하여야 한다."),
        ("none", "qzxv wkpt hjrlm bvcx zqwrt plkjh gfdsm nbvcx wqrtp"),
        ("mix", "The committee reviews the request and reports.\nDer Ausschuss prüft den Antrag und meldet das Ergebnis.\nok"),
        ("tiny", "hello"), ("null", None), ("empty", ""), ("long", "The committee reviews the request. " * 5000),
    ]
    df = spark.createDataFrame([(k, t, "fr-FR", "clash") for k, t in rows], "id string, text string, lang string, langs string")
    got = {r["id"]: r for r in L.detect(df, table).collect()}
    for code in ("de", "fr", "es", "en", "zh", "ja", "ko"):
        assert got[code]["langs"] == [code], code
        assert 0.5 < got[code]["confidence"] <= 1
    for k in ("none", "tiny", "null", "empty"):
        assert got[k]["langs"] == [] and got[k]["confidence"] is None
    assert [(s["first_line"], s["last_line"], s["lang"]) for s in got["mix"]["segments"]] == [(0, 0, "en"), (1, 2, "de")] and set(got["mix"]["langs"]) == {"de", "en"}
    assert got["long"]["langs"] == ["en"] and got["de"]["label"] == "fr"


def test_nothing_to_fit_on(spark):
    df = spark.createDataFrame([("a", "The committee reviews the request and reports.", "??")], "id string, text string, lang string")
    assert L.fit(df) is None
    assert L.detect(df, None).first()["langs"] == []
    assert L.detect(df.limit(0), None).count() == 0
