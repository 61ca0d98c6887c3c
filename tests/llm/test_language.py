import random

import numpy as np
import pytest

from kilim.llm import language as g
from kilim.llm import quality

TR = "komşu tavan kapı pencere yavaşça açtı kapattı geçen hafta bugün yarın ve ama çünkü için doğru eski küçük güzel okul ders öğretmen kitap gördü aldı verdi geldi".split()
EN = "the old man alone opened closed every quiet window yesterday because after class with under letter teacher found wrote carried small heavy and but on friday".split()
DE = "der alte mann und die lehrerin haben das kleine fenster gestern nicht geöffnet weil mein bruder einen langen brief unter dem tisch schreibt heute früh".split()
FR = "le vieux pont ma mère cherche une longue lettre près de la fenêtre mais hier soir chacun oublie son assiette pendant la pluie avec joie".split()
ES = "el vecino compra una manzana fresca en el mercado pero ayer nadie abre la ventana pequeña detrás de la casa con mucha alegría".split()
WORDS = dict(zip(g.LANGUAGES, (TR, EN, DE, FR, ES)))


def sentence(rng, lang, n=9):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    pairs = [(sentence(rng, k), i) for _ in range(150) for i, k in enumerate(g.LANGUAGES)]
    return g.Model(g.LANGUAGES).train([g.tokens(s) for s, _ in pairs], np.array([i for _, i in pairs]), (8, 1.0))


def test_held_out_accuracy(model):
    rng = random.Random(2)
    new = [(sentence(rng, k), k) for _ in range(60) for k in g.LANGUAGES]
    said = [v.lang for v in g.judge([s for s, _ in new], model)]
    assert sum(a == k for a, (_, k) in zip(said, new)) >= 0.98 * len(new)
    assert 0.5 <= model.least < 1


def test_mixed_and_segments(model):
    rng = random.Random(3)
    text = " ".join([sentence(rng, "tr") for _ in range(4)] + [sentence(rng, "de") for _ in range(3)] + [sentence(rng, "fr")])
    v = g.judge([text, None, "", "?!", "x" * 100_000], model)
    assert set(v[0].mixed) == {"tr", "de"}
    assert [(s[0], s[2]) for s in v[0].segments] == [("tr", 4), ("de", 3), ("fr", 1)]
    assert [x.lang for x in v[1:4]] == [None] * 3 and v[4].mixed == []


def test_sentences():
    assert g.sentences("Bir iki. Üç dört?\nbeş") == ["Bir iki.", "Üç dört?", "beş"]
    assert g.sentences("bir iki\nüç. Dört\nbeş altı. Yedi\nsekiz.") == ["bir iki üç.", "Dört beş altı.", "Yedi sekiz."]


def test_spellings(spark):
    df = spark.createDataFrame([("tr-TR", "tr"), ("English", "en"), (" DE ", "de"), ("und", None), ("?", None), ("", None), (None, None), ("fr-FR", "fr"), ("spa", "es")], "a string, b string")
    assert [r.x for r in df.select(g.spelled(df.a).alias("x")).collect()] == [r.b for r in df.collect()]


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(sentence(rng, k) for _ in range(4)), k) for i, k in enumerate(g.LANGUAGES * 40)]
    rows += [(1000, rows[0][1], "en"), (1000, rows[0][1], "en"), (1001, rows[1][1], None), (1002, rows[2][1], "German"), (1003, None, None), (1004, " ", "xx"), (1005, rows[5][1] + "\n" + rows[8][1], "tr")]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    model = g.sentence_model(df)
    common = frozenset(w for ws in WORDS.values() for w in ws)
    prof = quality.Profiles.of([(k, sentence(rng, k)) for k in g.LANGUAGES for _ in range(4)], common)
    j = g.document_languages(df, model, prof)
    assert j.count() == len(rows)
    got = {(r.key, r.lang) for r in g.wrong_documents(j).collect()}
    assert got == {(1000, "tr"), (1001, "en"), (1005, "tr"), (1005, "fr")}
    assert g.document_languages(df.limit(0), model, prof).count() == 0


def test_words(spark):
    rows = [(w, "TR") for w in TR for _ in range(5)] + [(w, "EN") for w in EN for _ in range(5)] + [(f"akça{i}", "NE") for i in range(9) for _ in range(4)]
    rows += [("kapı", None), ("kapı", ""), ("letter", "LANG3"), (None, "TR"), ("", "TR"), ("?", None)]
    df = spark.createDataFrame(rows, "form string, label string")
    lexicon = spark.createDataFrame([("Bahçe ", "TR", 1), ("garden", "EN", None), (None, "TR", 2)], "word string, lang string, word_rank int")
    forms, counts = g.plain_forms(df.where("form is not null"), lexicon)
    got = {r.form: r.lang for r in forms.collect()}
    assert {got.get(w) for w in TR} == {"tr"} and {got.get(w) for w in EN} == {"en"}
    assert not any(f.startswith("akça") for f in got) and "?" not in got
    assert {r.form: r.n for r in counts.collect()}["kapı"] == 7
    empty, _ = g.plain_forms(df.limit(0))
    assert empty.count() == 0
