import pytest

from kilim.operators import gold_grammar as gg


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("1,new,EN,", None),
        ("6,oysa,TR,\r", None),
        ('49,"""tamam""",OTHER,"a ""quoted"" word"', None),
        ('1,biraz,TR,"satır\nsonu var"', None),
        (",,,", None),
        (" ,,, ", None),
        (",SentenceID,71,", None),
        (",EmbedLang,-,", None),
        ('8,"luggage,MIXED,x', "QUOTING"),
        ('22,as"lında,TR,', "QUOTING"),
        ('2,"captaine" ,MIXED,captain-DAT', "QUOTING"),
        ('245,"mutlu"",TR,', "QUOTING"),
        (",MatrixLang", "COLUMNS"),
        ("48,seçti,TR,,", "COLUMNS"),
        ("", "COLUMNS"),
        (None, "COLUMNS"),
        (",MatrixLang,tr,", "VALUE"),
        (",SentenceID,0,", "VALUE"),
        ("24,x,TR ,", "VALUE"),
        ("3.0,x,TR,", "VALUE"),
        ("0,x,TR,", "VALUE"),
        ("5, ,TR,", "VALUE"),
        (",çantaya,TR,", "VALUE"),
        (",EmbedLang,EN,\x1b[0m", "VALUE"),
        ("1,a\rb,TR,", "VALUE"),
    ],
)
def test_reasons(raw, reason):
    assert gg.parse_line(raw).reason == reason


def test_place_of_the_error():
    assert gg.parse_line('22,as"lında,TR,').at == 5
    assert gg.parse_line("24,x,Mixed,").at == 5


def test_file_resumes_after_a_broken_quote():
    text = '1,a,TR,\n2,"open,EN,\n3,b,EN,\n,SentenceID,2,\r\n4,"x\ny",TR,"g"\n5,c,XX,\n'
    got = [(r.kind, r.token, r.reason) for _, r in gg.parse_file(text)]
    assert got == [("token", 1, None), (None, None, "QUOTING"), ("token", 3, None), ("meta", None, None), ("token", 4, None), (None, None, "VALUE")]
    assert list(gg.parse_file(None)) == list(gg.parse_file("")) == []


def test_frames(spark):
    df = spark.createDataFrame([(1, "1,a,TR,", "x"), (1, "1,a,TR,", "x"), (2, None, None), (3, "9" * 100_000, "y")], "line_id long, raw_line string, parsed string")
    assert {tuple(r) for r in gg.bad_lines(df).collect()} == {(2, "COLUMNS"), (3, "COLUMNS")}
    assert [tuple(r) for r in gg.good_lines(df).collect()] == [(1, "token", 1, "a", "TR", "")]
    assert gg.bad_lines(df.limit(0)).count() == 0
    files = spark.createDataFrame([("f", "1,a,TR,\n,,,\n"), ("g", None)], "name string, value string")
    assert gg.parse_files(files, "value", "name").count() == 2


def test_long_tokens_and_recovery_of_files(spark):
    r = gg.parse_line("1234567890123456789,abc,TR,")
    assert (r.kind, r.token, r.long_token, r.reason) == ("token", None, "1234567890123456789", None)
    good = [f"{i},söz{i},TR,\r" for i in range(1, 40)]
    rows = [("a.csv", i, i, x) for i, x in enumerate(good)] + [("a.csv", 40, 40, '7,"açık,TR,'), ("a.csv", 41, 41, "8,son,EN,"), ("a.csv", 41, 41, "8,son,EN,"), ("a.csv", gg.FILE_LINES, 42, "9,öbür,EN,"), (None, None, 43, ",,,"), ("a.csv", 44, 44, None)]
    got = gg.parse_delivered_files(spark.createDataFrame(rows, "file_name string, line_no int, line_id long, raw_line string")).collect()
    assert sorted((r.token or 0) for r in got if r.reason is None) == sorted([0, *range(1, 40), 8, 9])
    assert [(r.file, r.reason) for r in got if r.reason] == [("a.csv#0", "QUOTING")]


def test_resume_is_linear():
    text = '1,"açık,TR,\n' * 30_000 + "2,son,EN,"
    assert [r.token for _, r in gg.parse_file(text) if r.kind] == [2]
