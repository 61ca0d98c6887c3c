import pytest
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.operators import confidence as conf
from kilim.operators import labeling as lab
from kilim.operators import parser
from kilim.operators import rerank as rr

LEXICON = [("kitap", "TR", 0), ("ev", "TR", 1500), ("film", "TR", 2000), ("kapı", "TR", None), ("anla", "TR", 3), ("amazing", "EN", 1), ("boss", "EN", 2), ("upload", "EN", 3), ("design", "EN", 4), ("cloud", "EN", 5), ("game", "EN", 6), (" Book x", "EN", 7), ("", "TR", 1), (None, "TR", 1)]


@pytest.fixture(scope="module")
def look(spark):
    return lab.Lookups(lab.lexicon(spark.createDataFrame(LEXICON, "word string, lang string, word_rank int")))


def words(spark, ws):
    return spark.createDataFrame([("d", 1, i, w) for i, w in enumerate(ws)], "doc_id string, sent_no int, pos int, token string")


def labels(spark, look, ws, entities=None):
    return [r.label for r in lab.label(words(spark, ws), look, entities).orderBy("pos").collect()]


def test_golden(spark, look):
    docs = spark.createDataFrame([("d", "kitap amazing boss'um\n---")], "doc_id string, text string")
    tok, votes = lab.annotate(docs, look)
    rows = lab.annotated_rows(tok, votes).orderBy("sent_no", "o").collect()
    assert [(r.token, r.label) for r in rows] == [("SentenceID", "1"), ("kitap", "TR"), ("amazing", "EN"), ("boss'um", "MIXED"), ("MatrixLang", "TR"), ("EmbedLang", "EN"), ("SentenceID", "2"), ("MatrixLang", "TR"), ("EmbedLang", "-")]


def test_cascade(spark, look):
    got = labels(spark, look, ["kitap", "ev", "amazing", "boss'um", "kitap'ta", "bossa", "cloudumuza", "clouddan", "gamenin", "bossni", "xyz", "123", "@a", None, "boss's"])
    assert got == ["TR", "TR", "EN", "MIXED", "TR", "UID", "UID", "MIXED", "MIXED", "UID", "UID", "OTHER", "OTHER", None, "UID"]


def test_lid_and_config(spark):
    lex = lab.lexicon(spark.createDataFrame(LEXICON, "word string, lang string, word_rank int"))
    lid = spark.createDataFrame([("foo", "EN", 0.9), ("bar", "tr", 0.8), ("baz", "EN", 0.5)], "token_l string, lang string, prob double")
    assert labels(spark, lab.Lookups(lex, lid), ["foo", "bar", "baz", "foodan"]) == ["EN", "TR", "UID", "MIXED"]


def test_entities(spark, look):
    ents = spark.createDataFrame([("d", 1, "Amazing Boss", "ORGANIZATION"), ("d", 1, "cloud", "TIME"), ("d", 1, "upload", "PERSON"), ("d", 1, "design x", "ORGANIZATION"), ("d", 2, "kitap", "PERSON")], "doc_id string, sent_no int, text string, type string")
    assert labels(spark, look, ["Amazing", "Boss", "cloud", "upload", "design", "kitap"], ents) == ["NE", "NE", "EN", "NE", "EN", "TR"]


def test_vote_ties(spark):
    rows = [("d", 1, "TR"), ("d", 1, "EN"), ("d", 2, "EN"), ("d", 2, "MIXED"), ("d", 3, "OTHER"), ("d", 4, "EN"), ("d", 5, "MIXED")]
    df = spark.createDataFrame(rows, "doc_id string, sent_no int, label string").withColumn("token", F.lit("x"))
    got = {r.sent_no: (r.matrix_lang, r.embed_lang) for r in lab.sentence_votes(df).collect()}
    assert got == {1: ("TR", "EN"), 2: ("EN", "TR"), 3: ("TR", "-"), 4: ("EN", "-"), 5: ("TR", "EN")}


def test_nominal(spark):
    df = spark.createDataFrame([("lerimizden",), ("umuza",), ("iim",), ("lı",), ("",), (None,), ("q",)], "s string")
    got = [r.n for r in df.select(m.nominal(F.col("s")).alias("n")).collect()]
    assert [list(g.segments) for g in got[:5]] == [["ler", "imiz", "den"], ["umuz", "a"], ["i", "im"], ["l", "ı"], []]
    assert got[5] is None and list(got[6].deriv) == [m.LEFTOVER] and list(got[2].amb) == ["Amb=P3sg_or_Acc"]
    assert (len(m.CLOSED), len(m.FULL)) == (88, 64)


def test_residual(spark, look):
    df = spark.createDataFrame([(w,) for w in ("uploadlamışım", "designladık", "anladık", "Uploadladık", "qwladı", "upload")], "token string")
    got = {r.token: (r.promote, r.reason) for r in rr.residual(df, look).collect()}
    assert got["uploadlamışım"] == got["designladık"] == (True, "promoted")
    assert not any(got[w][0] for w in ("anladık", "Uploadladık", "qwladı", "upload"))
    assert got["Uploadladık"][1] == "proper_name_or_noise"


def test_candidates_and_strategies(spark):
    df = spark.createDataFrame([("filmlerimizden",), ("boss'umdan",), ("it's",), ("a",), (None,)], "token string")
    c = rr.candidates(df)
    best = {r.token: (r.stem, list(r.segments)) for r in rr.best(c).collect()}
    assert best["filmlerimizden"] == ("film", ["ler", "imiz", "den"]) and best["boss'umdan"] == ("boss", ["um", "dan"])
    assert set(best) == {"filmlerimizden", "boss'umdan"}
    with pytest.raises(ValueError):
        rr.best(c, "other")


def test_gate_features_and_recovery(spark, look):
    df = spark.createDataFrame([("bosslardan", "TR"), ("kitaplardan", "TR"), ("xyz", "UID"), ("Filmler", "NE"), ("Qqq", "NE"), ("boss", "EN")], "token string, label string")
    g = rr.gate(df, look)
    assert {r.token: r.candidate_reason for r in g.collect()} == {"bosslardan": "TR_SUSPECT_STEM", "kitaplardan": None, "xyz": "UID", "Filmler": "NE_SUFFIX", "Qqq": None, "boss": None}
    assert rr.features(g, look).where("token = 'bosslardan'").first().stem_in_en
    lex = lab.Lookups(lab.lexicon(spark.createDataFrame([("running", "EN", 1)], "word string, lang string, word_rank int")))
    stems = spark.createDataFrame([("runing",), ("run",)], "stem string")
    assert [(r.stem, r.recovered) for r in rr.recovered_stem(stems, lex).collect()] == [("runing", "running")]


def test_passes_and_confidence(spark, look):
    docs = spark.createDataFrame([("d", "kitap uploadlamışım evlerimde amazing 12"), ("e", "amazing boss qqq")], "doc_id string, text string")
    tok, votes = lab.annotate(docs, look)
    same, v = rr.passes(tok, votes, look)
    assert same.where("label <> rule_label or promoted_by is not null").count() == 0 and v.where("changed").count() == 0
    out, v = rr.passes(tok, votes, look, model=rr.unsure)
    got = {r.token: (r.rule_label, r.label, r.promoted_by) for r in out.collect()}
    assert got["uploadlamışım"] == ("UID", "MIXED", "residual")
    assert got["kitap"] == ("TR", "TR", None)
    assert {r.doc_id: r.changed for r in v.collect()}["e"] is False
    c = conf.scored(out.join(v.select("doc_id", "sent_no", "matrix_lang", "embed_lang"), ["doc_id", "sent_no"]))
    s = {r.token: r for r in c.collect()}
    assert s["uploadlamışım"].score == 0.72 and s["uploadlamışım"].band == "MEDIUM" and s["12"].score == 0.98
    assert s["qqq"].band != "HIGH" and s["kitap"].band == "HIGH"
    m_ = conf.manual(c, F.col("token") == "qqq").where("token = 'qqq'").first()
    assert (m_.score, m_.band, m_.reviewed, m_.review_recommended) == (1.0, "HIGH", True, False)
    assert {r.token for r in conf.review_queue(c, needle="QQ").collect()} == {"qqq"}
    rule = spark.createDataFrame([("d", 1, 0, "TR"), ("d", 1, 1, "UID")], "doc_id string, sent_no int, pos int, label string")
    two = words(spark, ["a", "b"]).withColumn("label", F.lit("TR"))
    assert [r.rule_label for r in conf.attach_rule_labels(two, rule, ("doc_id", "sent_no")).orderBy("pos").collect()] == ["TR", "UID"]
    assert [r.rule_label for r in conf.attach_rule_labels(two, rule.limit(1), ("doc_id", "sent_no")).collect()] == [None, None]


def test_parser(spark, look):
    df = spark.createDataFrame([("filmlerimizden",), ("geldi",), ("kitap",), ("zzz",), (None,), (" ",), ("clouddan",)], "token string")
    got = {r.token: r for r in parser.explanations(parser.parse(df, look)).collect()}
    assert (got["filmlerimizden"].root, list(got["filmlerimizden"].segments)) == ("film", ["ler", "imiz", "den"])
    assert (got["geldi"].root, list(got["geldi"].segments), got["geldi"].pos) == ("gel", ["di"], "verb")
    assert got["kitap"].source == "full_lexical_item" and got["zzz"].source == "whole_token_fallback"
    assert got["clouddan"].category == "english_root_turkish_suffix"
    assert got["geldi"].explained[0].category == "past_definite"
    assert len(got) == 5


def test_resolver_text(spark, look):
    df = spark.createDataFrame([("evlerimde",), ("Evlerde",), ("x1y",), ("kapıçığ",)], "token string")
    d = rr.decide(rr.resolver(df, look), F.lit("TR"))
    got = {r.token: (r.promote, r.score, r.reason) for r in d.collect()}
    assert got["evlerimde"] == (True, 7, "promoted") and got["Evlerde"][2] == "probable_proper_name" and got["x1y"][2] == "alphanumeric_identifier"
    e = d.select(rr.explain(F.col("token"), F.col("promote"), F.col("score"), F.col("evidence"), F.col("reason")).alias("e")).where("e like '%evlerimde%'").first().e
    assert "Proposed: TR" in e and "- trusted_lexicon" in e


def test_stream(spark, look, tmp_path):
    from kilim.streaming import annotate as st

    spark.createDataFrame([("d", "kitap amazing\nboss'um"), ("e", None)], "doc_id string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string").parquet(f"{tmp_path}/in")
    st.write_votes(stream, look, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.token, r.label) for r in spark.read.parquet(f"{tmp_path}/out/tokens").collect()} == {("kitap", "TR"), ("amazing", "EN"), ("boss'um", "MIXED")}
    q = st.labelled(stream, look).writeStream.format("memory").queryName("lab").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lab").count() == 3


def test_stream_counts(spark, look, tmp_path):
    from kilim.streaming import annotate as st

    spark.sql("select 'd' as doc_id, 'kitap amazing' as text, timestamp'2025-01-01 00:01:00' as at union all select 'e', 'kitap', timestamp'2025-01-01 01:00:00'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string, at timestamp").parquet(f"{tmp_path}/in")
    q = st.label_counts(stream, look, "at").writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.label, r.n) for r in spark.table("counts").collect()} >= {("TR", 1), ("EN", 1)}


