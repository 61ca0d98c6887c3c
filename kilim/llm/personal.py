"""Personal data in free text: found by bootstrapped contextual extraction, replaced by
typed placeholders.

Candidates are spans whose shape could be an e-mail address, telephone number, identity
number, address or name. A strict few are seeds: plain addresses with "@", international
numbers, numbers after the commonest identity keywords, addresses with the commonest street
words, and names that begin with a given name of the seed list. Each candidate carries
patterns: the words beside it, the surname and its endings, a number's shape, the keyword or
street word, how "@" is written and the last label of the host. Spark scores the graph of
patterns and instances in rounds: a pattern is trusted if enough different instances bear it
out and most of its candidates are accepted ones; an instance is accepted if trusted patterns
support it. What is accepted bears out patterns of the next round, so that shapes, keywords,
street words and given names outside the seeds are learned.

Nulls and empty texts hold nothing. Repeated rows count once. Whole texts are read; the graph
is aggregated on distinct instances, with map-side partial sums, and never collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilim.session import cut

ROUNDS = 3
PRECISION, DIVERSITY = 0.6, 3
"""A pattern is trusted if this share of its candidates is accepted, and so many different
given names (numbers: values) bear it out."""
SEEDS_MOST = 100_000
"""Seed names that are broadcast; more are an error."""
TYPES = ("EMAIL", "PHONE", "IDNUM", "ADDRESS", "NAME")

FOLD = str.maketrans("çğıöşüâîûİIÇĞÖŞÜ", "cgiosuaiuiicgosu")

AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|et)\s?[\])]\s?)"
DOT = r"(?:\.|\s?[\[(]\s?(?:dot|nokta)\s?[\])]\s?)"
EMAIL = re.compile(rf"(?<![\w@/.+-])[^\W_][\w.+-]*{AT}[^\W_][\w-]*(?:{DOT}[\w-]+)*{DOT}[^\W\d_]{{2,}}(?!\w)")
NUMBER = re.compile(r"(?<![\w.,@/:+(-])[+(]{0,2}\d[\d ().\-]{5,}\d(?![\w@/]|[.,:]\d)")
# Words before an identity number, folded.
IDENTITY = {"tc", "t.c", "tckn", "kimlik", "ssn", "security", "insurance", "nino", "ni", "passport", "pasaport", "vatandaslik"}
# The keywords and street words that make seeds; the others must be learned.
SEED_IDENTITY = {"tc", "t.c", "tckn", "ssn", "passport", "pasaport"}
SEED_STREETS = {"caddesi", "sokak", "street", "road", "str.", "rue", "calle"}
FILLERS = {"no", "no.", "no:", "number", "numarasi", "numaram", "numarasi:", "number:", "numara", "nr", "nr."}
COUNTRY_ID = re.compile(r"(?<!\w)(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,8})(?!\w)")
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
UP = r"[A-ZÇĞİÖŞÜ][^\W\d_]*(?:['’-][^\W\d_]+)*"
# Words for streets and quarters.
TR_STREET = r"(?i:cadde(?:s[iİ])?|cad\.|soka(?:k|ğ[ıI])|sok\.|sk\.|bulvar[ıI]|blv\.|mahalles[iİ]|mah\.|mh\.)"
TR_PLACE = rf"(?:(?:{UP} ){{1,3}}|{WORD} )"
EN_STREET = r"(?:Road|Rd|Lane|Ln|Street|St|Avenue|Ave|Drive|Close|Way|Court|Square|Hill|Terrace|Crescent)"
ADDRESSES = (
    re.compile(rf"(?<!\w){TR_PLACE}{TR_STREET}(?:,? *{TR_PLACE}{TR_STREET})?,? *(?i:no ?[:.]? ?)?\d{{1,4}}(?:/\d{{1,3}})?(?: *[Dd] ?[:.]? ?\d{{1,3}})?(?!\s*(?:gün|day|defa|kez|lira|TL|saat|yıl|\d|[.,:]\d))"),
    re.compile(rf"(?:Apt\.? ?\d{{1,4}}, ?|Flat \d{{1,4}}, ?)?\b\d{{1,4}} (?:{UP} ){{1,3}}{EN_STREET}\b\.?"),
    re.compile(r"(?<!\w)[^\W\d_]{3,}(?:str\.|straße|strasse|weg|platz|gasse) ?\d{1,4}[a-z]?(?!\w)", re.I),
    re.compile(rf"(?:calle|avenida|rue|avenue|boulevard|plaza) (?:{WORD} ){{1,4}},? ?\d{{1,4}}(?!\w)|(?<!\w)\d{{1,4}},? (?:rue|avenue|boulevard) (?:{WORD} ?){{1,4}}", re.I),
)
CITY = re.compile(rf",? {UP}(?!\w)")
TOKEN = re.compile(rf"[^\W\d_]\.(?= |$|[,;:!?)])|{WORD}|\d+|[^\w\s]")
INITIAL = re.compile(r"[A-ZÇĞİÖŞÜ]\.")

FOUND = "type string, form string, given string, surname string, fits boolean, start int, stop int, patterns array<string>, seed boolean"
FIELDS = ("type", "form", "given", "surname", "fits", "start", "stop", "patterns", "seed")
"""fits: the shape is that of the type and nothing speaks against it; seed: accepted at once."""
STREET = re.compile(rf"{TR_STREET}|{EN_STREET}\b|(?:str\.|straße|strasse|weg|platz|gasse)|\b(?:calle|avenida|rue|avenue|boulevard|plaza)\b", re.I)


def fold(word: str) -> str:
    return word.translate(FOLD).lower().replace("i̇", "i")


def beside(text: str, start: int, stop: int) -> list[str]:
    """Patterns of the words beside a span: the one before, the one after."""
    left = re.search(rf"({WORD})[.:,]? *$", text[max(0, start - 40) : start])
    right = re.match(rf"[,.]? *({WORD})", text[stop : stop + 40])
    return [*([f"L:{fold(left[1])}"] if left else []), *([f"R:{fold(right[1])}"] if right else [])]


def numbers(line: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    taken = list(taken)
    for m in [*COUNTRY_ID.finditer(line), *NUMBER.finditer(line)]:
        start, stop = m.span()
        if any(a < stop and start < b for a, b in taken):
            continue
        taken.append((start, stop))
        t = m[0].rstrip(" .-(")
        stop = start + len(t)
        digits = sum(c.isdigit() for c in t)
        before = [fold(w).rstrip(":.") for w in re.findall(r"[^\s()]+", line[max(0, start - 40) : start])][-3:]
        shape = "N:" + "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in t)
        around = [p for p in beside(line, start, stop)]
        words = [w for w in reversed(before) if w not in FILLERS]
        keyed = bool(words) and words[0] in IDENTITY
        alnum = t[0].isalpha()
        if not alnum and 10 <= digits <= 15 and t[0] in "+(0":
            yield "PHONE", "number", t, "", not keyed, start, stop, [shape, *around], not keyed and t[0] == "+"
        if alnum or 6 <= digits <= 12:
            key = [f"K:{words[0]}"] if words else []
            yield "IDNUM", "number", t, "", keyed and digits >= 6, start, stop, [shape, *key, *around], keyed and digits >= 6 and words[0] in SEED_IDENTITY


def names(line: str, given: frozenset[str]) -> Iterator[tuple]:
    toks = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(line)]

    def word(k: int) -> str | None:
        return toks[k][0] if 0 <= k < len(toks) and toks[k][0][:1].isupper() and len(toks[k][0]) > 1 and toks[k][0][-1] != "." else None

    def initial(k: int) -> bool:
        return 0 <= k < len(toks) and bool(INITIAL.fullmatch(toks[k][0]))

    def near(a: int, b: int) -> bool:
        return all(line[toks[k][2] : toks[k + 1][1]] in (" ", "") for k in range(a, b))

    for i in range(len(toks)):
        a = word(i)
        spans = []
        if a:
            if (b := word(i + 1)) and near(i, i + 1):
                turned = i + 3 < len(toks) and toks[i + 2][0] == "," and fold(toks[i + 3][0]) in given
                if not turned:  # else the second word is the surname of the name behind the comma
                    spans.append(("GS", i, i + 1, a, b))
                spans.append(("SG", i, i + 1, b, a))
            if initial(i + 1) and near(i, i + 1):
                spans.append(("GI", i, i + 1, a, ""))
                if (b := word(i + 2)) and near(i + 1, i + 2):
                    spans.append(("GIS", i, i + 2, a, b))
            if i + 2 < len(toks) and toks[i + 1][0] == "," and (b := word(i + 2)) and near(i, i + 2) and not (i + 3 < len(toks) and near(i + 2, i + 3) and (word(i + 3) or initial(i + 3))):
                spans.append(("SCG", i, i + 2, b, a))
        elif initial(i) and (b := word(i + 1)) and near(i, i + 1):
            spans.append(("IG", i, i + 1, b, ""))
        for form, x, y, g, s in spans:
            start, stop = toks[x][1], toks[y][2]
            gk, sk = fold(g), fold(s)
            known = gk in given
            if form in ("SG", "SCG", "IG") and not known:
                if form != "SCG":
                    continue
            ends = [f"E:{sk[-n:]}" for n in (3, 4, 5, 6) if len(sk) >= n + 2] + ([f"S:{sk}"] if sk else ["I:initial"])
            seed = known and form in ("GS", "GI", "GIS", "SCG")
            yield "NAME", form, gk, sk, seed, start, stop, ends + beside(line, start, stop), seed


def mail(text: str) -> tuple[list[str], bool]:
    """Patterns of an address, and whether it is a plain one."""
    at = re.search(AT, text)
    host = re.split(DOT, text[at.end() :]) if at else [text]
    return [f"M:{fold(at[0]) if at else ''}", f"D:{fold(host[-1])}"], not re.search(r"[\s()\[\]]", text)


def street(text: str) -> tuple[list[str], bool]:
    """Patterns of an address: its last street word and the shape of its numbers."""
    words = [fold(w) for w in STREET.findall(text)]
    shape = re.sub(r"\d+", "9", " ".join(re.findall(r"[^\s,]*\d[^\s,]*", text)))
    return [f"K:{words[-1]}" if words else "K:", f"N:{fold(shape)}"], bool(words) and words[-1] in SEED_STREETS


def candidates(text: str | None, given: frozenset[str]) -> list[tuple]:
    """Candidates of a text, line by line; offsets count in the whole text."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        taken: list[tuple[int, int]] = []
        found: list[tuple] = []
        for m in EMAIL.finditer(line):
            taken.append(m.span())
            own, plain = mail(m[0])
            found.append(("EMAIL", "mail", m[0], "", True, *m.span(), own + beside(line, *m.span()), plain))
        for rx in ADDRESSES:
            for m in rx.finditer(line):
                start, stop = m.span()
                if any(a < stop and start < b for a, b in taken):
                    continue
                if city := CITY.match(line, stop):
                    stop = city.end()
                taken.append((start, stop))
                own, plain = street(m[0])
                found.append(("ADDRESS", "address", m[0], "", True, start, stop, own + beside(line, start, stop), plain))
        found += numbers(line, taken)
        found += [n for n in names(line, given) if not any(a < n[6] and n[5] < b for a, b in taken)]
        out += [(*f[:5], f[5] + at, f[6] + at, *f[7:]) for f in found]
        at += len(line) + 1
    return out


MAYBE = r"[@\d]|\p{L}\.?,? +\p{Lu}|\((?:at|et)\)|\[(?:at|et)\]"


def found(texts: DataFrame, seeds: DataFrame, items: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """(table_name, rec_id, type, start, stop) of the accepted spans.

    texts: (table_name, rec_id, text). seeds: (name), a table of given names of fixed size;
    more than SEEDS_MOST raise an error. items: tables whose texts are single items, which
    have no context. rounds: 0 gives the seeds alone.
    """
    rows = seeds.select("name").where("name is not null").distinct().limit(SEEDS_MOST + 1).collect()
    if len(rows) > SEEDS_MOST:
        raise ValueError(f"more than {SEEDS_MOST} seed names")
    given = frozenset(fold(r.name.strip()) for r in rows)
    sent = texts.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for b in batches:
            rows = [(t, r, len(x), *c) for t, r, x in zip(b["table_name"], b["rec_id"], b["text"]) for c in candidates(x, g)]
            yield pd.DataFrame(rows, columns=["table_name", "rec_id", "size", *FIELDS])

    maybe = texts.where(F.col("text").rlike(MAYBE)).select("table_name", "rec_id", "text").distinct()
    c = cut(maybe.mapInPandas(run, "table_name string, rec_id long, size int, " + FOUND))
    alone = F.col("table_name").isin(*items) & (F.col("start") == 0) & (F.col("stop") == F.col("size")) if items else F.lit(False)
    c = c.withColumn("alone", alone)

    # the graph on distinct instances
    node = ["type", "form", "given", "surname", "fits", "seed", "alone", "patterns"]
    inst = cut(c.groupBy(*node).agg(F.count("*").alias("n")).withColumn("id", F.xxhash64(*node)))
    # every candidate for a name that isn't accepted speaks against its patterns; of the other
    # types only those that don't fit
    edges = inst.select("id", "type", "given", "n", ((F.col("type") == "NAME") | ~F.col("fits")).alias("counts"), F.explode("patterns").alias("pattern"))
    accepted = inst.where("seed").select("id")
    for _ in range(rounds):
        ok = edges.join(accepted.withColumn("ok", F.lit(True)), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        distinct_ok = ok.where("ok").select("type", "pattern", "given").distinct().groupBy("type", "pattern").agg(F.count("*").alias("givens"))
        score = ok.groupBy("type", "pattern").agg(F.sum(F.when(F.col("ok") | F.col("counts"), F.col("n")).otherwise(0)).alias("all"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("good"))
        trusted = score.join(distinct_ok, ["type", "pattern"]).where((F.col("givens") >= DIVERSITY) & (F.col("good") >= PRECISION * F.col("all"))).select("type", "pattern")
        kind = F.substring("pattern", 1, 1)
        support = (
            edges.join(trusted, ["type", "pattern"])
            .groupBy("id")
            .agg(
                F.max(kind.isin("E", "S")).alias("lexical"),
                F.max(kind == "I").alias("initial"),
                F.max(kind.isin("L", "R")).alias("context"),
                F.max(kind == "N").alias("shape"),
                F.max(kind.isin("K", "M", "D")).alias("word"),
            )
        )
        s = inst.join(support, "id", "left").na.fill(False, ["lexical", "initial", "context", "shape", "word"])
        known = cut(inst.join(accepted, "id", "left_semi").where("type = 'NAME' and form in ('GS', 'GIS', 'SCG')").join(support.where("lexical"), "id", "left_semi").select("given").distinct())
        s = s.join(known.withColumn("known", F.lit(True)), "given", "left").withColumn("known", F.coalesce("known", F.lit(False)) | F.col("seed"))
        borne = F.col("context") | F.col("word")
        numeric = F.col("type").isin("PHONE", "IDNUM") & (
            F.col("seed") | (F.col("shape") & F.col("context")) | (F.col("fits") & (F.col("shape") | borne)) | (F.col("shape") & F.col("alone") & (F.col("type") == "PHONE"))
        )
        spelled = F.col("type").isin("EMAIL", "ADDRESS") & (F.col("seed") | borne)
        name = (F.col("type") == "NAME") & (
            (F.col("known") & F.col("form").isin("GI", "GIS", "IG"))
            | (F.col("lexical") & (F.col("known") | F.col("context") | F.col("alone")))
            | (F.col("known") & F.col("context") & (F.col("form") == "GS"))
        )
        accepted = cut(s.where(numeric | spelled | name).select("id"))
    hit = c.withColumn("id", F.xxhash64(*node)).join(accepted, "id", "left_semi")
    return hit.select("table_name", "rec_id", "type", "start", "stop").distinct()


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(table_name, rec_id, text): the records with spans, each replaced by [TYPE].

    Of overlapping spans the one that starts first, then the longer, counts; the rest of the
    text is unchanged.
    """
    by = spans.groupBy("table_name", "rec_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("back"), "type"))).alias("spans"))

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans):
            parts, at = [], 0
            for s in ss:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['type']}]"]
                    at = -s["back"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    t = texts.select("table_name", "rec_id", "text").distinct().join(by, ["table_name", "rec_id"])
    return t.select("table_name", "rec_id", put("text", "spans").alias("text"))
