import math

import pytest

from kilim.llm import garble as g



def whole(word):
    """The word mapped back as one run."""
    return g.from_utf8_runs(word, [(0, len(word))])


GOOD = ["Bölüm", "başkanı", "yavaşça", "küçük", "gün", "için", "ayakkabıyı", "köftede", "güneşleri", "kalkıyor", "söyleyecek", "şarkıya", "İlk", "öğleden", "ışık", "ağaç"]


@pytest.mark.parametrize("word", GOOD)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp437", "mac_roman"])
def test_utf8_round_trip(word, wrong):
    raw = word.encode()
    bad = "".join(bytes([b]).decode(wrong, errors="ignore") or chr(b) for b in raw) if wrong != "latin-1" else raw.decode(wrong)
    if bad != word:
        assert whole(bad) == word


def test_twice():
    bad = "söyleyeceğiz".encode().decode("cp1252").encode().decode("cp1252")
    assert whole(bad) == "söyleyeceğiz"


@pytest.mark.parametrize("word", ["São", "irmã", "þ", "Â", "£", "m²", "düşündün", "şç", "góðan", "señora", "привет", "👩‍💻", "hâlâ"])
def test_sound_words_have_no_mapping(word):
    assert whole(word) is None


def test_segments_are_maximal():
    model = g.Model({p: -2.0 for p in ("^a", "ab", "ba", "a$", "b$")})
    assert g.segments("abab", model) == []
    assert [x[:2] for x in g.segments("abXYab", model)] == [(1, 5)]


def test_the_model_decides():
    def common(*words):
        return g.Model({p: -6.0 for w in words for p in map("".join, zip(f"^{w}", f"{w}$"))})

    assert g.analyse("baþka", common("başka", "bal")).status == "single"
    assert g.analyse("baþka", common("baþka")).status == "sound"  # an established sequence
    assert g.analyse("baþka", g.Model({p: -6.0 for p in ("aþ", "þk")})).status == "sound"  # the mapping gives less likely pairs
    assert g.analyse("yÃ¼z", common("yüz")) == g.Finding("garbled", "yüz", None, "yã¼z")
    assert g.analyse("yÃ¼z", common("yÃ¼z")).status == "sound"
    assert g.analyse("ne?ki", common("ne?ki")).status == "sound"
    assert g.analyse("ne?ki", common("neşki")).status == "garbled"
    assert g.analyse("a\x85b", common("a\x85b")).status == "sound"
    assert g.analyse("a\x85b", common("ab")).status == "garbled"


def test_pair_model_counts_every_pair(spark):
    rows = [("ab", 30), ("ba", 20), ("c", 9), ("xy", 1)]
    m = g.pair_model(spark.createDataFrame(rows, "word string, n long"))
    pairs = {}
    for w, n in rows:
        for p in map("".join, zip(f"^{w}", f"{w}$")):
            pairs[p] = pairs.get(p, 0) + n
    total = sum(pairs.values())
    side = lambda i, c: sum(n for p, n in pairs.items() if p[i] == c) / total
    mine = {p: n / total * math.log2(n / total / side(0, p[0]) / side(1, p[1])) for p, n in pairs.items()}
    mine = {p: v for p, v in mine.items() if v > 0}
    want = {p: math.log2(v / sum(mine.values())) for p, v in mine.items() if pairs[p] >= g.PAIR_LEAST}
    assert m.score.keys() == want.keys() and all(abs(m.score[p] - want[p]) < 1e-9 for p in want)
    assert g.pair_model(spark.createDataFrame([], "word string, n long")).score == {}


TEXTS = [
    ("datasets", 1, "Bölüm başkanı geldi\nyeni ayakkabıyı gördü?"),
    ("datasets", 2, "Bölüm başkanı geldi yeni ayakkabıyı gördü"),
    ("datasets", 3, "BÃ¶lÃ¼m baþkaný geldi"),
    ("datasets", 3, "BÃ¶lÃ¼m baþkaný geldi"),
    ("datasets", 4, "yeni ayakkab?y? gördü"),
    ("datasets", 5, "yeni ayakkab�y� g�rd�"),
    ("datasets", 6, "https://a.b/c?d=1 þakka þ harfi geldi?"),
    ("datasets", 7, None),
    ("datasets", 8, ""),
    ("gold_rows", 1, "ba?kan?"),
    ("gold_rows", 2, "geldi"),
]


def test_frame(spark):
    df = spark.createDataFrame(TEXTS, "table_name string, rec_id long, text string").where("text is not null")
    found = g.findings(df, ("gold_rows",))
    assert {(r.table_name, r.rec_id) for r in found.collect()} == {("datasets", 3), ("datasets", 4), ("datasets", 5), ("gold_rows", 1)}
    back = {(r.table_name, r.rec_id): r.restored for r in g.restored_texts(df, found).collect()}
    assert back == {("datasets", 3): "Bölüm başkanı geldi", ("datasets", 4): "yeni ayakkabıyı gördü", ("datasets", 5): "yeni ayakkabıyı gördü", ("gold_rows", 1): "başkanı"}
    assert g.findings(df.limit(0)).count() == 0


def test_long_word():
    assert whole("a" * 20_000 + "Ã¼") == "a" * 20_000 + "ü"
