import random

import pytest
from pyspark.sql import functions as F

from kilim.operators import alignment as al
from kilim.operators import dictionary as dic
from kilim.operators import evaluate as ev
from kilim.operators import train as tr
from kilim.sources import files


def scores(spark):
    rng = random.Random(1)
    rows = [(i, y := int(rng.random() < 0.3), round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 2)) for i in range(400)] + [(1000, 1, 1.0), (1001, 0, 0.0), (1002, 0, None)]
    return rows, spark.createDataFrame(rows, "i int, target int, prob double")


def test_thresholds(spark):
    rows, df = scores(spark)
    got = {round(r.threshold, 2): r for r in ev.threshold_table(df).collect()}
    assert len(got) == 99
    for t in (0.01, 0.29, 0.5, 0.57, 0.99):
        tp = sum(1 for _, y, p in rows if p is not None and p >= t and y)
        fp = sum(1 for _, y, p in rows if p is not None and p >= t and not y)
        assert (got[t].tp, got[t].fp, got[t].tp + got[t].fn) == (tp, fp, sum(y for _, y, _ in rows))
    sel = {r.choice: r for r in ev.select_thresholds(ev.threshold_table(df)).collect()}
    best = max(got.values(), key=lambda r: (r.f1, -r.threshold))
    assert sel["max_f1"].threshold == best.threshold
    assert ev.threshold_table(df.limit(0)).agg(F.max("tp")).first()[0] == 0


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.3), (0, 0.3)], "target int, prob double")
    r = ev.ranking_metrics(df).first()
    assert r.roc_auc == pytest.approx((2 + 1 + 0.5) / 6)
    assert r.average_precision == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert ev.ranking_metrics(df.where("target = 1")).first().roc_auc is None


def test_reports(spark):
    df = spark.createDataFrame([("TR", "TR"), ("TR", "EN"), ("EN", "EN"), ("NE", "TR")], "gold_label string, pred_label string")
    got = {r.label: r for r in ev.multiclass_report(df).collect()}
    assert (got["TR"].precision, got["TR"].recall, got["NE"].f1, got["EN"].support) == (0.5, 0.5, 0.0, 1)
    assert ev.summary(df).first().accuracy == 0.5
    b = ev.binary_metrics(df, F.col("gold_label") == "TR", F.col("pred_label") == "TR").first()
    assert (b.tp, b.fp, b.fn, b.tn) == (1, 1, 1, 1)


def test_cascade_and_policies(spark):
    rows = [("MIXED", "UID", True, 0.9, True), ("TR", "TR", True, 0.9, True), ("EN", "UID", True, 0.9, False), ("MIXED", "NE", True, 0.6, False), ("NE", "NE", True, 0.9, True), ("TR", "TR", False, 0.9, True)]
    df = spark.createDataFrame(rows, "gold_label string, pred_label string, is_candidate boolean, prob double, stem_evidence boolean").withColumn("target", (F.col("gold_label") == "MIXED").cast("int"))
    s = {r.pred_label: r for r in ev.cascade_summary(ev.cascade(df, F.col("is_candidate") & (F.col("prob") >= 0.5))).collect()}
    assert (s[None].n_changes, s[None].beneficial, s[None].harmful, s[None].neutral) == (5, 2, 2, 1)
    p = {r.policy: r for r in ev.policies(df, 0.5, 0.8).collect()}
    assert p["block_ne"].rank == 1 and p["unrestricted"].n_genuine_ne_retained == 1 and p["ne_threshold"].n_harmful_ne == 1
    assert {r.pred_label: r.n for r in ev.candidate_metrics(df, 0.5).collect()}[None] == 5
    with pytest.raises(ValueError):
        ev.policy_flips("x", 0.5, 0.5)


def test_grouped_split(spark):
    blocks = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(120)] + [(500, 3), (501, 4)], "block_index int, n_mixed int")
    a = {r.block_index: (r.stratum, r.split) for r in ev.grouped_split(blocks).collect()}
    assert len(a) == 122 and a == {r.block_index: (r.stratum, r.split) for r in ev.grouped_split(blocks.repartition(7)).collect()}
    for s, n in (("one", 30), ("none", 90)):
        part = [v for _, v in a.items() if v[0] == s]
        assert len(part) == n and {v[1] for v in part} == {"train", "dev", "test"}
    assert sorted(a[i][1] for i in (500, 501)) == ["dev", "train"]
    assert a != {r.block_index: (r.stratum, r.split) for r in ev.grouped_split(blocks, seed=7).collect()}


def test_alignment(spark):
    s = "block_index int, position_in_block int, gold_token_id long, item string, label string"
    gold = spark.createDataFrame([(0, 0, 1, "a", "TR"), (0, 1, 2, "REDACTED", "NE"), (1, 0, 3, "b", "MIXED"), (2, 0, 4, "c", "EN"), (2, 1, 5, "d", "EN"), (3, 0, 6, "e", "XX")], s)
    pred = spark.createDataFrame([(0, 0, 1, " a", "TR"), (0, 1, 2, "q", "NE"), (1, 0, 3, "b", "UID"), (2, 0, 4, "x", "EN"), (2, 1, 5, "d", "EN"), (3, 0, 6, "e", "TR")], s)
    rows, bad = al.align(gold, pred)
    assert {r.gold_token_id for r in rows.collect()} == {1, 2, 3, 6} and [r.block_index for r in bad.collect()] == [2]
    rows, bad = al.align(gold, pred, tokens_out=spark.createDataFrame([(4,)], "gold_token_id long"), blocks_out=spark.createDataFrame([(1,)], "block_index int"))
    assert {r.gold_token_id for r in rows.collect()} == {1, 2, 5, 6} and bad.count() == 0
    assert [r.gold_token_id for r in al.invalid_labels(rows).collect()] == [6]
    f = "line_no int, token string, item string"
    e = al.structure_errors(spark.createDataFrame([(1, "1", "a"), (2, "", "MatrixLang"), (3, "", "")], f), spark.createDataFrame([(1, "1", "b"), (2, "", "EmbedLang")], f))
    assert {r.line_no for r in e.collect()} == {2, 3}
    m = spark.createDataFrame([(1, "5", None), (2, "6", "7")], "block_index int, gold_parent_token_id string, gold_echo_token_id string")
    assert [r.block_index for r in al.excluded_blocks(m).collect()] == [0]
    x = spark.createDataFrame([("9", "i", "r"), (None, "", "")], "token_id string, item string, reason string")
    assert {r.gold_token_id for r in al.excluded_tokens(x, m).collect()} == {9, 6, 7}


def test_files(spark, tmp_path):
    (tmp_path / "tr.txt").write_text("Kitap 5\n\nev\nkitap\n", encoding="utf-8")
    assert {(r.word, r.word_rank) for r in files.word_list(spark, f"file://{tmp_path}/tr.txt", "TR").collect()} == {("kitap", 0), ("ev", 2)}
    assert files.word_list(spark, f"file://{tmp_path}/no.txt", "TR", missing_ok=True).count() == 0
    (tmp_path / "g.csv").write_text('Token,Item,Label,Gloss\n1,"a, b",TR,\n,SentenceID,1,\n,,,\n', encoding="utf-8")
    assert [(r.token, r.item) for r in files.gold_csv(spark, f"file://{tmp_path}/g.csv").orderBy("line_no").collect()][:2] == [("1", "a, b"), ("", "SentenceID")]
    (tmp_path / "h.csv").write_text("Token,Item\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.gold_csv(spark, f"file://{tmp_path}/h.csv")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        files.utf8_texts(spark, f"file://{tmp_path}/bad.bin").collect()
    assert files.utf8_texts(spark, f"file://{tmp_path}/tr.txt").first().text.startswith("Kitap")
    assert len(files.digests(spark, f"file://{tmp_path}/tr.txt").first().sha256) == 64


ENTRY = {"madde": "ev", "lisan": "", "telaffuz": None, "birlesikler": "ev bark|ev ev", "atasozu": [], "deyimler": [{"madde": "ev açmak"}], "anlamlarListe": [{"anlam": "konut", "ozelliklerListe": [{"tam_adi": "isim"}, {"tam_adi": "mecaz"}], "orneklerListe": [{"ornek": "bir ev"}]}]}


def test_dictionary(spark):
    d = dic.mock(spark, {"Ev": ENTRY})
    t = spark.createDataFrame([("EV",), ("ev'",), ("yok",), ("",), (None,)], "term string")
    got = [(r.term, r.status) for r in dic.lookup(t, d).collect()]
    assert sorted(got, key=str) == sorted([("EV", "FOUND"), ("ev'", "FOUND"), ("yok", "NOT_FOUND"), ("", "NOT_FOUND"), (None, "NOT_FOUND")], key=str)
    e = dic.entries(d).first()
    assert (e.status, e.headword, e.pos, list(e.compounds), list(e.idioms)) == ("FOUND", "ev", "isim", ["ev bark", "ev ev"], ["ev açmak"])
    assert list(e.senses[0].usage) == ["mecaz"] and list(e.senses[0].examples) == ["bir ev"]
    raw = spark.createDataFrame([('{"error": "x"}',), ("[]",), ("<html>",), (None,)], "body string")
    assert [r.status for r in dic.entries(raw).collect()] == ["NOT_FOUND", "NOT_FOUND", "UNAVAILABLE", "UNAVAILABLE"]
    a = {r.query: r.status for r in dic.ask(t, dic.unavailable, "none").collect()}
    assert a == {"ev": "UNAVAILABLE", "yok": "UNAVAILABLE", "": "NOT_FOUND"}
    s = spark.createDataFrame([("FOUND", ["a"], ["a"]), ("FOUND", ["a"], ["b"]), ("FOUND", ["a"], None)], "s string, t array<string>, o array<string>")
    assert [r.x for r in s.select(dic.mark_stale(F.col("s"), F.col("t"), F.col("o")).alias("x")).collect()] == ["FOUND", "STALE_RESULT", "FOUND"]


def test_training(spark, tmp_path):
    rng = random.Random(2)
    rows = [("".join(rng.choice("bcdf") for _ in range(4)) + ("dan" if y else "x"), y, "UID", 7, s) for s, n in (("train", 120), ("dev", 40)) for _ in range(n) for y in [int(rng.random() < 0.3)]]
    df = spark.createDataFrame(rows, "text string, target int, pred_label string, token_length int, split string")
    model, chosen = tr.fit_and_report(df, most_iter=15)
    assert {r.choice: r.f1 for r in chosen.collect()}["max_f1"] > 0.95
    tr.save(model, f"{tmp_path}/b", ["token_length", "pred_label"], 0.5)
    again, threshold = tr.load(spark, f"{tmp_path}/b", ["pred_label", "token_length"])
    assert threshold == 0.5 and tr.predict(again, df).count() == 160
    assert tr.load(spark, f"{tmp_path}/b", ["other"]) is None and tr.load(spark, f"{tmp_path}/no", []) is None
    assert len(tr.contract_problems({"threshold": True}, ["a"])) == 5
