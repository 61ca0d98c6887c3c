import pytest

from kilim.llm import personal as p

GIVEN = frozenset({"elif", "onur", "defne", "selin", "kerem", "nora", "clara", "mert"})


def kinds(text):
    return {(c[0], text[c[5] : c[6]]) for c in p.candidates(text, GIVEN) if c[0] in ("EMAIL", "ADDRESS") or c[4]}


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("Mail: percikgil.ofis @ mail.test", "EMAIL", "percikgil.ofis @ mail.test"),
        ("bana nehir [at] example [dot] net yaz", "EMAIL", "nehir [at] example [dot] net"),
        ("(E_LIF@DEPT.INVALID) diye", "EMAIL", "E_LIF@DEPT.INVALID"),
        ("tel +33 6 39 98 10 93", "PHONE", "+33 6 39 98 10 93"),
        ("Numaram (312) 555-0108, akşam", "PHONE", "(312) 555-0108"),
        ("0(599)002-04-32", "PHONE", "0(599)002-04-32"),
        ("T.C. no 51531681212.", "IDNUM", "51531681212"),
        ("SSN: 000-07-1166 istediler", "IDNUM", "000-07-1166"),
        ("NI number QQ 76 72 42 C yazıyordu", "IDNUM", "QQ 76 72 42 C"),
        ("passport no. ZZ6190359.", "IDNUM", "ZZ6190359"),
        ("we moved to kuyubaşı mahallesi menevşe sokak 28 last", "ADDRESS", "kuyubaşı mahallesi menevşe sokak 28"),
        ("kargoyu Ilgınlı Caddesi No:106/11 Sarnıçlı adresine", "ADDRESS", "Ilgınlı Caddesi No:106/11 Sarnıçlı"),
        ("Apt 21, 174 Old Kiln Rd, Yeşiltepe", "ADDRESS", "Apt 21, 174 Old Kiln Rd, Yeşiltepe"),
        ("Mönkemoorstr. 12, Tekvera", "ADDRESS", "Mönkemoorstr. 12, Tekvera"),
        ("Ben Elif Y., üçüncü", "NAME", "Elif Y."),
        ("signed by CLARA MARLOMERE", "NAME", "CLARA MARLOMERE"),
    ],
)
def test_seeds(text, kind, span):
    assert (kind, span) in kinds(text)


@pytest.mark.parametrize(
    "text",
    ["@selin_notlar54 takip et", "ders@ yazmış 88 defa", "sipariş numarası 4821054 kargoda", "takip no 93200412", "toplam 1.250.377 TL", "18.04.2064 tarihinde", "Kavakdibi sokak yine kapalı 43 gündür", "Mossgate Road is closed for 68 days", "Selin dün gelmedi", "Kerem and Nora left at 64", "Kavakdibi Caddesi", "", None],
)
def test_no_seeds(text):
    assert kinds(text or "") == set()


def test_bootstrap(spark):
    rows = [("datasets", i, f"kapı açık\nSayın {g} {s}gil, merhaba") for i, (g, s) in enumerate([("Elif", "Kavlız"), ("Onur", "Tezmür"), ("Mert", "Bordanç"), ("Clara", "Hızlanç"), ("Sezgiyar", "Kavlız")])]
    rows += [("datasets", 20 + i, f"Defne Kırtasiye {i} lira") for i in range(6)]
    rows += [("datasets", 30, None), ("datasets", 31, ""), ("datasets", 32, "x" * 100_000 + " tel +90 599 052 28 97")]
    rows += [("gold_rows", 1, "Sezgiyar K."), ("gold_rows", 1, "Sezgiyar K."), ("gold_rows", 2, "Kuzey Meydanı"), ("gold_rows", 3, "Yüzgil, Onur"), ("gold_rows", 4, "elif@mail.test"), ("gold_rows", 5, "Elif")]
    df = spark.createDataFrame(rows, "table_name string, rec_id long, text string").where("text is not null")
    seeds = spark.createDataFrame([(n,) for n in ("Elif", "Onur", "Mert", "Clara", "Defne", "ELİF", None)], "name string")
    spans = p.found(df, seeds, ("gold_rows",))
    got = {(r.table_name, r.rec_id, r.type) for r in spans.collect()}
    names = {("datasets", i, "NAME") for i in range(5)} | {("gold_rows", 1, "NAME"), ("gold_rows", 3, "NAME")}
    assert got == names | {("datasets", 32, "PHONE"), ("gold_rows", 4, "EMAIL")}
    back = {(r.table_name, r.rec_id): r.text for r in p.redacted(df, spans).collect()}
    assert back["datasets", 0] == "kapı açık\nSayın [NAME], merhaba"
    assert back["datasets", 32] == "x" * 100_000 + " tel [PHONE]"
    assert p.found(df.limit(0), seeds).count() == 0


def test_each_type_is_learned_beyond_its_seeds(spark):
    rows = []

    def add(*texts):
        rows.extend(("datasets", len(rows) + i, t) for i, t in enumerate(texts))

    add(*[f"bana {n}@mail.test adresinden yaz" for n in ("ela", "can", "su")], "bana nil (at) mail.test adresinden yaz")
    add(*[f"beni +90 599 052 28 {n} numarasından ara" for n in (11, 12, 13)], *[f"beni 0599 052 28 {n} numarasından ara" for n in (21, 22, 23)], "0599 052 28 31")
    add(*[f"evim Çınar Caddesi No:{n} diye bilinir" for n in (4, 5, 6)], *[f"evim Çınar Bulvarı No:{n} diye bilinir" for n in (7, 8, 9)], "Kavak Bulvarı No:3")
    add(*[f"formda SSN 000-07-{n} istediler" for n in (1166, 1167, 1168)], "formda insurance 000-07-1170 istediler", "kargo 000-07 numara")
    df = spark.createDataFrame(rows, "table_name string, rec_id long, text string")
    seeds = spark.createDataFrame([("Elif",)], "name string")
    found = [{(r.rec_id, r.type) for r in p.found(df, seeds, rounds=n).collect()} for n in (0, 3)]
    count = [{t: sum(k == t for _, k in f) for t in p.TYPES} for f in found]
    assert count[0] == {"EMAIL": 3, "PHONE": 3, "ADDRESS": 3, "IDNUM": 3, "NAME": 0}
    assert count[1] == {"EMAIL": 4, "PHONE": 7, "ADDRESS": 7, "IDNUM": 4, "NAME": 0}
