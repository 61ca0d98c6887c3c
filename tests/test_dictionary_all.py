import re
import unicodedata

from kilim import queries


def normal(term):
    """tdk.normalize_query of the reference, with the apostrophes of kilim."""
    s = re.sub("['’‘ʼ`]", "", unicodedata.normalize("NFC", term)).strip()
    return re.sub(r"^\W+|\W+$", "", s).replace("İ", "i").replace("I", "ı").lower()


def expected(items, words):
    known = {normal(w) for w in words} - {""}
    return {(t, normal(t), "FOUND" if normal(t) in known else "NOT_FOUND") for t in items}


def test_fixture(spark, tmp_path):
    items = ["İpek", "ESKİ", "eski ev", "ev.", "(ev)", "e\u0301v", "év", "Ev'de", "EV’", "...", "", " ", "ILIK", "e-posta", "12", None, "ev."]
    words = ["ipek", " Eski ", "ev", "év", "ılık", "eski ev", "e-posta", "evde", None]
    spark.createDataFrame([(i,) for i in items], "item string").write.parquet(f"{tmp_path}/gold_rows.parquet")
    spark.createDataFrame([(w, "TR") for w in words] + [("12", "EN")], "word string, lang string").write.parquet(f"{tmp_path}/lexicon.parquet")
    got = [tuple(r) for r in queries.QUERIES["dictionary_lookup_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected({i for i in items if i is not None}, [w for w in words if w])
    assert ("İpek", "ipek", "FOUND") in got and ("eski ev", "eski ev", "FOUND") in got and ("...", "", "NOT_FOUND") in got


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    items = {r.item for r in spark.read.parquet(f"{d}/gold_rows.parquet").select("item").distinct().collect() if r.item is not None}
    words = [r.word for r in spark.read.parquet(f"{d}/lexicon.parquet").where("lang = 'TR'").collect() if r.word]
    got = [tuple(r) for r in queries.QUERIES["dictionary_lookup_all"](spark, d).collect()]
    assert len(got) == len(items) and set(got) == expected(items, words)
