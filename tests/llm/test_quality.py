import pytest

from kilim.llm import quality as q

PROSE = [("en", "The old man alone described the quiet letters after class. Nobody cleaned the empty kitchen on friday evening."), ("tr", "Geçen hafta komşumuz eski tavanı sessizce anlattı. Kimse bu sene sıcak köylerde öğretmeni bulmadı.")] * 5
COMMON = frozenset(w for _, t in PROSE for w in q.words_of(t)) | frozenset("drums servers drawer teachers stamp cousins station backup pencil".split())
P = q.Profiles.of(PROSE, COMMON)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, None),
        (" \n ", None),
        (PROSE[0][1], "prose"),
        ("[12:30] " + PROSE[1][1] + "\n- " + PROSE[0][1], "prose"),
        ("- drums\n- servers\n* teachers stamp\n- drawer\n- cousins", "list"),
        ("Servers:\ndrums\nstamp\nteachers cousins\ndrawer", "list"),
        ("drums = stamp\nservers = drawer\nteachers = cousins", "list"),
        ("| drums | stamp |\n|---|---|\n| station | 4 |\n| backup | 6 |", "table"),
        ("drums\t1\t2\nstamp\t3\t4\nbackup\t5\t6", "table"),
        ("backup          4618      91.0%\nstation           55      38.0%\npencil       1      2.0%", "table"),
        ("pencil,13,494\nstation,2,7\nbackup,9,1", "table"),
        ("sil kjjkgşa silgsfgd lşkgsfksdjgsh iskhgids gkfhifş", "junk"),
        ("9czxK4c7pDbzZsy7/ZjXvAw2pmEOng4tP8C1HfWLWV2sA2C14", "junk"),
        ("🎉👍🔥 😀✨ 🎉🎉", "junk"),
        ("..\n;;\nl\n0\nI\n!!!\n___", "junk"),
        ("stamp " * 60, "junk"),
        (PROSE[0][1] * 3 + "\n- drums\n- stamp", "prose"),
        ("stamp " * 200_000, "junk"),
    ],
)
def test_kinds(text, kind):
    assert q.kind_of(text, P) == kind


def test_counts():
    n, mean, symbols, ended, common, far, kind = q.stats_of("The old man.\nzzqx 12", P)
    assert (n, ended, common, kind is not None) == (4, 0.5, 0.75, True)
    assert mean == (3 + 3 + 3 + 4) / 4
    assert symbols == 1 / 16
    assert 0 <= far <= 2


def test_divergence():
    assert q.jsd({"a": 1.0}, {"a": 1.0}) == 0
    assert q.jsd({"a": 1.0}, {"b": 1.0}) == 1


def test_frame(spark):
    rows = [(1, PROSE[0][1], "x"), (1, PROSE[0][1], "x"), (2, None, None), (3, "", "y"), (4, "- drums\n- stamp\n- drawer", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.n_words, r.kind) for r in q.statistics(df, P).collect())
    assert got == [(1, 18, "prose"), (1, 18, "prose"), (2, 0, None), (3, 0, None), (4, 3, "list")]
    assert q.statistics(df.limit(0), P).count() == 0
    assert q.common_words(df.limit(0)) == frozenset()
    assert {r.word: r.n for r in q.document_frequency(df).collect()}["drums"] == 1


def test_profiles_read_all_prose(spark):
    # in the order of the texts, Turkish stands behind 10,000 rows of English
    english = spark.range(10_010).selectExpr("'en' as lang", "concat('An old man cleaned kitchen ', id, if(id % 9 = 0, ' quietly', ' today'), '.') as text")
    rest = [("tr", "Öğretmen sıcak köylerde kimseyi bulmadı."), ("tr", "Öğretmen eski tavanı\nsessizce anlattı 🎉"), (None, "zz 12 | x9"), ("tr", None), ("de", "")]
    prose = english.unionByName(spark.createDataFrame(rest, "lang string, text string"))
    docs = spark.createDataFrame([(t,) for _, t in PROSE], "text string")
    got = q.profiles_of(docs, prose)
    want = q.Profiles.of([(r.lang, r.text) for r in prose.collect()], q.common_words(docs))
    key = repr
    assert sorted(([sorted(c.items()), sorted(w.items())] for c, w in got.prose), key=key) == sorted(([sorted(c.items()), sorted(w.items())] for c, w in want.prose), key=key)
    assert (got.function, got.common) == (want.function, want.common)
    assert "öğretmen" in got.function and "quietly" in got.function and len(got.prose) == 4
    assert q.profiles_of(docs, prose.limit(0)).prose == []


def test_common_words_without_limit(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "xyz"]
    df = spark.createDataFrame([(" ".join(words),)] * 3, "text string")
    assert q.common_words(df) == frozenset(words) and len(words) > 50_000
