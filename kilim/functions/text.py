"""Tokens, shapes and normal forms of text, as built-in column expressions.

Patterns are written so that Java's and RE2's engines read them alike: letters are \\p{L},
digits \\p{Nd}, a word character [\\p{L}\\p{N}_].
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the token grammar, most specific first.
TOKEN = (
    r"https?://\S+|www\.\S+|@[\p{L}\p{N}_]+|#[\p{L}\p{N}_]+|[\x{10000}-\x{10FFFF}]+"
    r"|\p{Nd}+(?:[.,:/-]\p{Nd}+)+|[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+"
    r"|[\p{L}\p{N}_]+['’]?[\p{L}\p{N}_]*|[\p{L}\p{N}_]+|['’]"
)
LINE = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SOLID = r"[^\s\p{Z}]"
URL, MENTION, HASHTAG = r"^(?i:https?://\S|www\.\S)", r"^@[\p{L}\p{N}_]", r"^#[\p{L}\p{N}_]"
NUMBER = r"^\p{Nd}+(?:[.,:/-]\p{Nd}+)*$"
CODE = r"^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+$"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
SIGNS = r"^[^\p{L}\p{N}]+$"
META = ("matrixlang", "embedlang", "sentenceid", "sentid", "sentence_id", "sent_id")
APOSTROPHES = "'’‘ʼ`"


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, line): the non-blank lines of each text, numbered from 1. Null: none."""
    lines = F.filter(F.split(F.col(text), LINE), lambda x: x.rlike(SOLID))
    return docs.select(key, F.posexplode(lines).alias("n", "line")).select(key, (F.col("n") + 1).alias("sent_no"), "line")


def tokens(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_no"), line: str = "line", outer: bool = False) -> DataFrame:
    """(keys, pos, token), pos from 0; outer keeps a line without tokens as one row of nulls."""
    explode = F.posexplode_outer if outer else F.posexplode
    return lines.select(*keys, explode(F.regexp_extract_all(F.col(line), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))


def shape(token: Column) -> Column:
    """What makes a token OTHER by its shape, null for words. Null and empty tokens: empty."""
    code = token.rlike(CODE) & token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    return (
        F.when(token.isNull() | (token == ""), "empty")
        .when(token.rlike(URL), "url")
        .when(token.rlike(MENTION), "mention")
        .when(token.rlike(HASHTAG), "hashtag")
        .when(token.rlike(NUMBER), "number")
        .when(code, "code")
        .when(token.rlike(ASTRAL), "emoji")
        .when(token.rlike(SIGNS), "signs")
    )


def clean(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\p{L}\p{N}_'’]+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def casefold(text: Column) -> Column:
    """Lower case with ß and final sigma folded; what it lacks against full folding are rare letters."""
    return F.translate(F.regexp_replace(F.lower(text), "ß", "ss"), "ς", "σ")


def frequency_form(token: Column) -> Column:
    """The form under which tokens are counted, null if nothing is left."""
    return F.nullif(casefold(F.regexp_replace(strip(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), F.lit(""))


def match_form(token: Column, exact_surface: bool = False, case_sensitive: bool = False) -> Column:
    t = token if exact_surface else F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.nullif(t if case_sensitive else casefold(t), F.lit(""))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def nfc(text: Column) -> Column:
    """Composed characters; Spark has no built-in for it."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(text)


def dictionary_query(text: Column) -> Column:
    """The form a word is looked up by: NFC, without apostrophes and edge signs, Turkish lower case."""
    t = F.translate(nfc(F.coalesce(text, F.lit(""))), APOSTROPHES, "")
    return turkish_lower(F.regexp_replace(strip(t), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))


def is_meta(token: Column) -> Column:
    """Blank tokens and the meta rows' names; null is none."""
    t = strip(token)
    return F.coalesce((t == "") | t.isin("MatrixLang", "EmbedLang") | F.lower(t).isin(*META[2:]), F.lit(False))


def apostrophe_parts(token: Column) -> Column:
    """struct(base, suffix) of a token with one apostrophe inside, null for others and for
    English contractions."""
    p = F.split(token, "['’]")
    s = F.get(p, F.lit(1))
    ok = (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (s != "") & ~F.lower(s).isin("s", "re", "ve", "m", "ll", "d", "t")
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("base"), s.alias("suffix")))


def delimiter_parts(token: Column) -> Column:
    """struct(stem, suffix) at the last hyphen, else at the last straight apostrophe."""
    cut = F.when(F.contains(token, F.lit("-")), F.lit("-")).when(F.contains(token, F.lit("'")), F.lit("'"))
    suffix = F.when(cut == "-", F.substring_index(token, "-", -1)).when(cut == "'", F.substring_index(token, "'", -1)).otherwise(token)
    stem = F.when(cut.isNotNull(), F.substr(token, F.lit(1), F.length(token) - F.length(suffix) - 1)).otherwise("")
    return F.struct(stem.alias("stem"), suffix.alias("suffix"))


def manual_segments(text: Column, token: Column) -> Column:
    """struct(root, segments, success) of a segmentation typed as root+seg-seg."""
    p = F.filter(F.split(text, r"[+\-\s]+"), lambda x: x != "")
    root, segs = F.get(p, F.lit(0)), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    ok = F.coalesce(F.lower(F.array_join(p, "")) == F.lower(token), F.lit(False)) & (F.size(p) > 0)
    return F.struct(root.alias("root"), segs.alias("segments"), ok.alias("success"))


def manual_root(root: Column, token: Column) -> Column:
    """struct(root, segments, success): the rest of the token behind a typed root is one segment."""
    ok = F.coalesce((root != "") & F.startswith(F.lower(token), F.lower(root)), F.lit(False))
    rest = F.substr(token, F.length(root) + 1)
    segs = F.when(ok & (rest != ""), F.array(rest)).otherwise(F.array().cast("array<string>"))
    return F.struct(root.alias("root"), segs.alias("segments"), ok.alias("success"))


def lookup_terms(segmentation: Column) -> Column:
    return F.filter(F.transform(F.split(segmentation, r"[+\-]"), strip), lambda x: x != "")


def shown(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Not provided"))


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def file_slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(strip(name), r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("dataset"))


def preview(text: Column, width: int = 40) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substr(text, F.lit(1), F.lit(width)), F.lit("…"))).otherwise(text)
