import pytest

from kilim.llm import lookalike as l


@pytest.mark.parametrize(
    ("word", "form"),
    [
        ("ｋａdar", "kadar"),
        ("dŏruça".replace("ŏ", "o") + "ğ", "doruçağ"),
        ("mi̇stake", "mistake"),
        (" bazen", "bazen"),
        ("ye​ni", "yeni"),
        ("﻿my", "my"),
        ("ﬁxed", "fixed"),
        ("waiter＇in", "waiter'in"),
    ],
)
def test_sure_forms(word, form):
    f = l.form_of(word)
    assert (f.odd, f.form) == (True, form)


@pytest.mark.parametrize("word", ["m²", "👩‍💻", "привет", "καλημέρα", "señora", "ありがとう", "başkanı", "boss’um", "“", ""])
def test_ordinary(word):
    assert l.form_of(word).odd is False


@pytest.mark.parametrize("word", ["tаblоdаn", "асtuаllу", "Ιlgarονa", "рrојесt"])
def test_mixed_scripts(word):
    f = l.form_of(word)
    assert f.odd and any(t.isascii() for t in f.repairs)


def test_frame(spark):
    rows = [("gold_rows", i, w) for i, w in enumerate(["tablodan", "tablodan", "project", "project", "çok", "çok", "oysa", "oysa"])]
    rows += [("gold_rows", 50, "tаblоdаn"), ("gold_rows", 50, "tаblоdаn"), ("gold_rows", 51, "рrојесt"), ("gold_rows", 52, "qаqzz"), ("gold_rows", 53, "привет"), ("gold_rows", 54, "Ã¶"), ("gold_rows", 55, "șoför")]
    rows += [("token_rows", 50, "çok"), ("token_rows", 51, ""), ("token_rows", 52, "m²"), ("token_rows", 53, "x" * 50_000 + "​")]
    df = spark.createDataFrame(rows, "table_name string, rec_id long, text string")
    got = {(r.table_name, r.rec_id): r.form for r in l.forms(df).collect()}
    assert got.pop(("token_rows", 53)) == "x" * 50_000
    assert got == {("gold_rows", 50): "tablodan", ("gold_rows", 51): "project", ("gold_rows", 52): "qаqzz", ("token_rows", 50): "çok"}
    assert l.forms(df).count() == 5
    assert l.forms(df.limit(0)).count() == 0
