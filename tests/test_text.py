import pytest
from pyspark.sql import functions as F

from kilim.functions import text as t


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("word_123_test", ["word_123_test"]),
        ("çalışma İstanbul ğüşöç", ["çalışma", "İstanbul", "ğüşöç"]),
        ("Bugün meeting'e gitmem lazım", ["Bugün", "meeting'e", "gitmem", "lazım"]),
        ("a-b", ["a-b"]),
        ("---", []),
        ("", []),
        ("bak https://x.y/z?q=1 @ali #gün 12:30 20li 😀😀 A7K-204 '", ["bak", "https://x.y/z?q=1", "@ali", "#gün", "12:30", "20li", "😀😀", "A7K-204", "'"]),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert [r.token for r in t.tokens(t.sentences(df)).orderBy("sent_no", "pos").collect()] == want


def test_sentences(spark):
    df = spark.createDataFrame([(1, "bir\n\n  \r\niki\x0büç\u2028dört"), (2, None), (3, " ")], "doc_id int, text string")
    assert [(r.sent_no, r.line) for r in t.sentences(df).orderBy("sent_no").collect()] == [(1, "bir"), (2, "iki"), (3, "üç"), (4, "dört")]


def test_shapes(spark):
    got = column(spark, ["", None, "http://a", "@a", "#b", "12:30", "A7-b", "a-b", "😀", "...", "söz", "20li"], t.shape)
    assert got == ["empty", "empty", "url", "mention", "hashtag", "number", "code", None, "emoji", "signs", None, None]


def test_forms(spark):
    assert column(spark, [" 'THINK' ", "...", None, "Straße", "boss'um"], t.frequency_form) == ["think", None, None, "strasse", "boss'um"]
    assert column(spark, ["Bo\u0301ss’um ", None, "(ISPARTA)"], t.dictionary_query) == ["bóssum", "", "ısparta"]
    assert column(spark, ["SentenceID", "sent_id", " ", "MatrixLang", "matrixlang", "x", None], t.is_meta) == [True, True, True, True, False, False, False]
    got = column(spark, ["boss'um", "it's", "a'b'c", "'x", "can't", None], t.apostrophe_parts)
    assert [None if g is None else tuple(g) for g in got] == [("boss", "um"), None, None, None, None, None]
    got = column(spark, ["film-ler-im", "boss'um", "boss’um", "x"], t.delimiter_parts)
    assert [tuple(g) for g in got] == [("film-ler", "im"), ("boss", "um"), ("", "boss’um"), ("", "x")]


def test_small_ones(spark):
    assert column(spark, ["C:\\a\\b.txt", "/x/y.csv", None], t.basename) == ["b.txt", "y.csv", None]
    assert column(spark, [" Veri 1/2 ", "***", None], t.file_slug) == ["Veri_1_2", "dataset", "dataset"]
    assert column(spark, ["", None, "a"], t.shown) == ["Not provided", "Not provided", "a"]
    assert column(spark, ["a" * 50, "b"], t.preview) == ["a" * 40 + "…", "b"]
    df = spark.createDataFrame([("film+ler-imiz", "Filmlerimiz"), ("x+y", "z"), ("", "a")], "s string, t string")
    got = [r.m for r in df.select(t.manual_segments(F.col("s"), F.col("t")).alias("m")).collect()]
    assert [(m.root, list(m.segments), m.success) for m in got] == [("film", ["ler", "imiz"], True), ("x", ["y"], False), (None, [], False)]
    df = spark.createDataFrame([("film", "Filmler"), ("x", "a"), ("", "a")], "s string, t string")
    got = [r.m for r in df.select(t.manual_root(F.col("s"), F.col("t")).alias("m")).collect()]
    assert [(list(m.segments), m.success) for m in got] == [(["ler"], True), ([], False), ([], False)]
