"""One consistent form for words that look the same but differ in characters.

A word's characters are brought to their ordinary form: invisible characters go (the joiner
of an emoji sequence stays), odd blanks become the plain blank, full-width forms and
ligatures their plain letters, combining marks their composed letters. Look-alike letters of
another script are repaired by script: a word of more than one script is turned towards its
dominant script, the others being tried where that gives no word of the corpus; a word
wholly in another script, or with look-alikes inside one script, is only touched when the
result is a word of the corpus. Signs that look different (m²), words of other scripts and
letters of other languages stay.

Nulls and empty texts have no odd character. Repeated rows count once. Only rows with odd
characters go to Python; the corpus' words are counted over all rows.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilim.llm import garble

# Letters that look like a Latin letter. Cyrillic, then Greek, small then capital.
TO_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ї": "ï", "ё": "ë",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Latin letters that look like a Turkish one, and signs like the apostrophe.
NEAR = {"ș": "ş", "Ș": "Ş", "ț": "ţ", "Ț": "Ţ", "ǧ": "ğ", "Ǧ": "Ğ", "ɡ": "g", "ɑ": "a", "ӧ": "ö", "ĭ": "ı"}
APOSTROPHES = "ʼʹ′´`＇‛ˈꞌ"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

ODD = r"[^\x20-\x7EçğıöşüÇĞİÖŞÜ’‘“”]"
PICTURE = re.compile("[\u2190-\u2bff\U0001f000-\U0001faff\ufe0f]")


def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


FROM_LATIN: dict[str, dict[str, str]] = {}
for _far, _near in TO_LATIN.items():
    FROM_LATIN.setdefault(script(_far), {}).setdefault(_near, _far)


class Form(NamedTuple):
    odd: bool
    """Holds a character that is not ordinary, whatever the corpus says."""
    form: str
    """The ordinary form as far as it is sure."""
    tries: list[str]
    """Keys of repairs that need a word of the corpus, best first."""
    repairs: list[str]


FORM = "odd boolean, form string, tries array<string>, repairs array<string>"


def without_invisible(word: str) -> str:
    out = []
    for i, c in enumerate(word):
        if c in INVISIBLE:
            beside = word[i - 1 : i] + word[i + 1 : i + 2]
            if c == "\u200d" and len(beside) == 2 and all(PICTURE.match(x) or 0x1F3FB <= ord(x) <= 0x1F3FF for x in beside):
                out.append(c)
            continue
        out.append(c)
    return "".join(out)


def plain(word: str) -> str:
    """What can be brought to its ordinary form without a look at the corpus."""
    t = without_invisible(word)
    t = "".join(" " if c in BLANKS else unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uff5e" or "\ufb00" <= c <= "\ufb06" or "\U0001d400" <= c <= "\U0001d7ff" else c for c in t)
    t = unicodedata.normalize("NFC", t).replace("i\u0307", "i").replace("ı\u0307", "i")
    letters = [i for i, c in enumerate(t) if c in APOSTROPHES and 0 < i < len(t) - 1 and t[i - 1].isalpha() and t[i + 1].isalpha()]
    for i in letters:
        t = t[:i] + "'" + t[i + 1 :]
    return t.strip(" ") if t.strip(" ") else t


def by_script(word: str) -> tuple[list[str], bool]:
    """Repairs towards each script of the word, dominant first; True if the word mixes scripts
    and every letter of the lesser ones looks like one of the main."""
    count: dict[str, int] = {}
    for c in word:
        if s := script(c):
            count[s] = count.get(s, 0) + 1
    if not count or set(count) == {"LATIN"}:
        return [], False
    order = sorted(count, key=lambda s: (-count[s], s != "LATIN"))
    out, mixed = [], False
    for s in order + ["LATIN"] * ("LATIN" not in count):
        table = TO_LATIN if s == "LATIN" else FROM_LATIN.get(s, {})
        t = "".join(c if not script(c) or script(c) == s else table.get(c, "\0") for c in word)
        if "\0" not in t and t != word and t not in out:
            out.append(t)
            mixed |= len(count) > 1
    return out, mixed


def form_of(word: str) -> Form:
    sure = plain(word)
    odd = sure != word
    tries: list[str] = []
    turned, mixed = by_script(sure)
    if mixed:
        odd = True
    near = "".join(NEAR.get(c, c) for c in sure)
    for t in [*turned, *([near] if near != sure else [])]:
        if t not in tries:
            tries.append(t)
    return Form(odd, sure, [garble.key_of(t.strip(garble.EDGES)) for t in tries], tries)


def forms(texts: DataFrame) -> DataFrame:
    """(table_name, rec_id, text, form) of the records with odd characters, once each.

    texts: (table_name, rec_id, text), the text a word or a few. Records that are garbled by
    a wrong encoding are left out. form: the consistent form; a repair is taken only if it is
    a word of the corpus, else the word keeps its letters.
    """
    odd = texts.where(F.col("text").rlike(ODD)).distinct()

    @F.pandas_udf(FORM)
    def look(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([form_of(t) if not is_garbled(t) else Form(False, t, [], []) for t in s], columns=list(Form._fields))

    distinct = odd.select("text").distinct().select("text", look.asNondeterministic()(F.col("text")).alias("f")).select("text", "f.*").where("odd or size(tries) > 0")
    known = texts.where(~F.col("text").rlike(ODD)).groupBy(garble.key(F.col("text")).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= garble.VOCABULARY_LEAST)
    tried = distinct.select("text", F.posexplode(F.arrays_zip("tries", "repairs"))).select("text", "pos", F.col("col.tries").alias("key"), F.col("col.repairs").alias("repair"))
    best = tried.join(known, "key").groupBy("text").agg(F.min_by("repair", "pos").alias("repair"))
    chosen = distinct.join(best, "text", "left").where("odd or repair is not null").select("text", F.coalesce("repair", "form").alias("form"))
    return odd.join(chosen, "text").select("table_name", "rec_id", "text", "form")


def is_garbled(word: str) -> bool:
    """As far as the word alone shows it: lost letters, or a mapping from UTF-8 that fits."""
    if garble.LOST in word or any(0x80 <= ord(c) < 0xA0 for c in word):
        return True
    for i, c in enumerate(word):
        if ord(c) > 127 and (not i or ord(word[i - 1]) < 128):
            j = i
            while j < len(word) and ord(word[j]) > 127:
                j += 1
            if garble.from_utf8(word[i:j]) is not None:
                return True
    return False
