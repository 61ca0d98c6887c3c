"""Text that was decoded with the wrong character encoding: detection and repair.

1. Adjacent characters are scored by their share of the corpus' mutual information, taken
   from the counts of all words. 2. In a word, maximum-scoring segments of improbable pairs
   are the runs that may be garbled; a word without any is sound. 3. Only inside those runs
   (and the non-ASCII characters they touch) inverse mappings are tried: encode as the wrong
   encoding, decode as the right one, up to three times for text garbled twice. A mapping from
   UTF-8 must decode without error; one between single-byte encodings, which always decodes,
   must give no less likely pairs and a word of the corpus. Lost letters (U+FFFD, or "?" inside a
   word) and stray control characters count in those runs alone; they can't be undone by a
   mapping, and are restored where one corpus word alone fits.

Nulls and empty texts are never garbled. Repeated rows count once. Words of any length are
read whole. Statistics cover all rows; only rows with suspicious characters go to Python.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.session import cut

# Encodings a text may have been read in, and those it may have been written in.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1254", "iso8859-9", "cp437", "cp850", "cp852", "cp857", "mac_roman", "mac_turkish", "cp1251", "cp1253", "cp1257", "koi8-r")
SINGLE = (("cp1252", "cp1254"), ("cp1250", "cp1254"), ("cp437", "cp857"), ("mac_roman", "mac_turkish"))
TURKISH = "çğıöşüÇĞİÖŞÜ"
LOST = "�"

IMPROBABLE, SATURATED = -12.0, -20.0
"""log2 of a pair's share of the mutual information under which it counts as improbable, and
under which it weighs the same as an unseen one. Shares add up to 1, so that at most
2 ** -SATURATED pairs are above; the model holds no others."""
PAIR_LEAST = 8
"""Occurrences under which a pair is no evidence and scores as unseen."""
VOCABULARY_LEAST = 2
"""Occurrences from which a word of plain letters is a word of the corpus."""

SUSPICIOUS = r"[^\x00-\x7FçğıöşüÇĞİÖŞÜ’‘“”]|[\p{L}]\?+[\p{L}]|(?:^|\s)\?+\p{L}|\p{L}\?|[\x7F]"
BLANKS = r"[ \n\r\t]+"
PLAIN_WORD = r"^[A-Za-zçğıöşüÇĞİÖŞÜ]+(?:['’][A-Za-zçğıöşüÇĞİÖŞÜ]+)?$"
EDGES = ".,;:!…\"“”()[]‘’'"


def key(word: Column) -> Column:
    return F.lower(F.translate(word, "İI", "ii"))


def key_of(word: str) -> str:
    return word.replace("İ", "i").replace("I", "i").lower()


def skeleton_of(word: str) -> str:
    return "".join("?" if c in TURKISH or c == LOST else c.lower() for c in word)


class Model(NamedTuple):
    score: dict[str, float]
    """log2 of each pair's share of the mutual information, as far as it is not SATURATED."""

    def weight(self, pair: str) -> float:
        """From IMPROBABLE - SATURATED for an unseen pair down to -4 for a common one."""
        return max(-4.0, IMPROBABLE - max(SATURATED, self.score.get(pair, SATURATED)))


def segments(word: str, model: Model) -> list[tuple[int, int, float]]:
    """Maximum-scoring segments (start, end, score) of improbable pairs, as characters; in order.

    Each pair weighs how far it lies under IMPROBABLE; segments are the maximal ones, found
    in one pass over cumulative sums.
    """
    text = "^" + word + "$"
    found: list[list[float]] = []  # start pair, end pair, sum before, sum after
    total = 0.0
    for i in range(len(text) - 1):
        w = model.weight(text[i : i + 2])
        before, total = total, total + w
        if w <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < new[2]), None)
            if j is None or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(max(0, int(a) - 1), min(len(word), int(b)), y - x) for a, b, x, y in found]


def widen(word: str, start: int, end: int) -> tuple[int, int]:
    """The run with all non-ASCII characters that touch it."""
    while start and ord(word[start - 1]) > 127:
        start -= 1
    while end < len(word) and ord(word[end]) > 127:
        end += 1
    return start, end


def wrong_bytes(text: str, encoding: str) -> bytes | None:
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) < 0xA0:  # bytes the encoding leaves open are often kept as they are
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def sound(text: str) -> bool:
    """Latin letters, ASCII, common signs and pictures."""
    return all(c.isascii() or 0xA0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 or 0x2010 <= ord(c) < 0x2200 or ord(c) >= 0x1F000 for c in text) and "\x7f" not in text


def from_utf8(run: str) -> str | None:
    """The run before UTF-8 was read as something else, once to three times; None if no mapping fits."""
    out, at = None, run
    if all(c.isascii() or c in TURKISH + "’‘“”" for c in run):
        return None
    for _ in range(3):
        options = []
        for e in WRONG:
            raw = wrong_bytes(at, e)
            if raw is None or raw.isascii():
                continue
            try:
                t = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(t) < len(at):
                options.append((not all(c.isascii() or c in TURKISH for c in t), not sound(t), t))
        if not options:
            break
        at = min(options)[2]
        if sound(at):
            out = at
    return out


class Finding(NamedTuple):
    status: str
    """garbled; or single / lost / edge: to be decided by the corpus' words; or sound."""
    restored: str | None
    wanted: str | None
    """The key (single) or skeleton (lost, edge) to look up among the corpus' words."""
    bare: str | None
    """The key of the word as it stands, without its edges."""


FINDING = "status string, restored string, wanted string, bare string"


def as_likely(new: str, old: str, model: Model) -> bool:
    """The pairs in which two words of one length differ weigh no more in the new one."""
    x, y = f"^{new}$", f"^{old}$"
    at = [i for i in range(len(x) - 1) if x[i : i + 2] != y[i : i + 2]]
    return sum(model.weight(x[i : i + 2]) for i in at) <= sum(model.weight(y[i : i + 2]) for i in at)


def from_utf8_runs(token: str, spans: list[tuple[int, int]]) -> str | None:
    """The token with every run that maps back from UTF-8 mapped, or None if none does."""
    out, done, hit = [], 0, False
    for a, b in spans:
        a = max(a, done)
        if a >= b:
            continue
        back = from_utf8(token[a:b])
        if back is None:  # part of the run may map
            for x in range(a, b):
                if x >= done and ord(token[x]) > 127:
                    for y in range(b, x + 1, -1):
                        if (t := from_utf8(token[x:y])) is not None:
                            out += [token[done:x], t]
                            done, hit = y, True
                            break
            continue
        out += [token[done:a], back]
        done, hit = b, True
    return "".join([*out, token[done:]]) if hit else None


def analyse(token: str, model: Model) -> Finding:
    """What the improbable runs of the token are; nothing outside them is looked at. A mapping
    between single-byte encodings must not give less likely pairs."""
    core = token.strip(EDGES)
    bare = key_of(core)
    spans = [widen(token, a, b) for a, b, _ in segments(token, model)]
    if not spans:
        return Finding("sound", None, None, bare)
    at = {i for a, b in spans for i in range(a, b)}
    if (back := from_utf8_runs(token, spans)) is not None:
        return Finding("garbled", back, None, bare)
    if any(token[i] == LOST for i in at):
        return Finding("garbled", None, skeleton_of(core), bare)
    if any(0x80 <= ord(token[i]) < 0xA0 for i in at):
        return Finding("garbled", None, None, bare)
    if "?" in core and not any(c in core for c in "/=@&<>"):
        if not any(token[i] == "?" for i in at):
            return Finding("sound", None, None, bare)
        inner = core.strip("?")
        if "?" in inner and inner.replace("?", "").replace("'", "").replace("’", "").isalpha():
            return Finding("garbled", None, skeleton_of(core if core[:1] == "?" else core.rstrip("?") if core.endswith("??") else core), bare)
        if inner.replace("'", "").replace("’", "").isalpha():
            return Finding("lost" if core[0] == "?" else "edge", None, skeleton_of(core), key_of(inner))
        return Finding("sound", None, None, bare)
    for wrong, right in SINGLE:
        back = list(token)
        for i in at:
            if ord(token[i]) > 127 and token[i] not in TURKISH:
                try:
                    back[i] = token[i].encode(wrong).decode(right)
                except UnicodeError:
                    pass
        t = "".join(back)
        if t != token and all(c.isascii() or c in TURKISH + "’‘“”…" for c in t) and as_likely(t, token, model):
            return Finding("single", t, key_of(t.strip(EDGES + "?")), key_of(core.strip("?")))
    return Finding("sound", None, None, bare)


def words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all blank-separated words; the counts are merged map-side first."""
    return texts.select(F.explode(F.split(F.col(text), BLANKS)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pair_model(counted: DataFrame) -> Model:
    """counted: (word, n). The pairs of each distinct word are counted n times; all of them
    make up the totals, and those with an unsaturated share of the information come back."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(marked, i, F.lit(2)))
    counts = cut(counted.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    sides = counts.withColumn("l", F.substr("pair", F.lit(1), F.lit(1))).withColumn("r", F.substr("pair", F.lit(2), F.lit(1)))
    left, right = (counts.groupBy(F.substr("pair", F.lit(i), F.lit(1)).alias(c)).agg(F.sum("n").alias(f"n_{c}")) for i, c in ((1, "l"), (2, "r")))
    p = F.col("n") / F.lit(total)
    mine = sides.join(left, "l").join(right, "r").select("pair", "n", (p * F.log2(p / (F.col("n_l") / F.lit(total)) / (F.col("n_r") / F.lit(total)))).alias("mine")).where("mine > 0")
    mine = cut(mine)
    whole = mine.agg(F.sum("mine")).first()[0] or 1.0
    kept = mine.where(F.col("n") >= PAIR_LEAST).select("pair", F.log2(F.col("mine") / F.lit(whole)).alias("score")).where(F.col("score") > SATURATED).toArrow()
    return Model(dict(zip(kept["pair"].to_pylist(), kept["score"].to_pylist())))


def corpus_words(counted: DataFrame) -> DataFrame:
    """(wanted, known): keys of the corpus' words of plain letters, and how often they occur."""
    core = F.regexp_replace("word", r"^[.,;:!?…\"“”()\[\]‘’']+|[.,;:!?…\"“”()\[\]‘’']+$", "")
    w = counted.select(core.alias("w"), "n").where(F.col("w").rlike(PLAIN_WORD))
    return w.groupBy(key(F.col("w")).alias("wanted")).agg(F.sum("n").alias("known"), F.min("w").alias("form")).where(F.col("known") >= VOCABULARY_LEAST)


def findings(texts: DataFrame, single_words: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, rec_id, token, restored) for every garbled word of `texts`.

    texts: (table_name, rec_id, text). single_words: tables whose texts are single words,
    where a "?" at the edge of a word can't be punctuation. restored is null where the
    original can't be known.
    """
    counted = cut(words(texts))
    model = pair_model(counted)
    sent = texts.sparkSession.sparkContext.broadcast(model.score)

    @F.pandas_udf(FINDING)
    def look(s: pd.Series) -> pd.DataFrame:
        m = Model(sent.value)
        return pd.DataFrame([analyse(t, m) for t in s], columns=list(Finding._fields))

    odd = counted.where(F.col("word").rlike(SUSPICIOUS)).select(F.col("word").alias("token"))
    seen = odd.select("token", look.asNondeterministic()(F.col("token")).alias("f")).select("token", "f.*").where("status <> 'sound'")
    known = corpus_words(counted)
    letters = F.lower(F.translate("form", TURKISH, "?" * len(TURKISH)))
    skeletons = known.groupBy(letters.alias("wanted")).agg(F.count("*").alias("fits"), F.min("form").alias("fit"))
    by_key = known.select("wanted", "known")
    as_is = known.select(F.col("wanted").alias("bare"), F.col("known").alias("established"))
    single = seen.where("status = 'single'").join(by_key, "wanted", "left_semi").select("token", "restored", "status", F.lit(False).alias("word_only"))
    holes = seen.where("status in ('lost', 'edge') or (status = 'garbled' and wanted is not null)").join(skeletons, "wanted", "left").join(as_is, "bare", "left")
    small = F.col("token").rlike(r"^[^\p{Lu}]*$")
    fit = F.when(small, F.lower(F.translate("fit", "İI", "iı"))).otherwise(F.col("fit"))
    holes = holes.where("status = 'garbled' or (fits is not null)").select(
        "token", F.when(F.col("fits") == 1, fit).alias("restored"), "status", F.expr("status = 'edge' and established is not null").alias("word_only")
    )
    plain = seen.where("status = 'garbled' and wanted is null").select("token", "restored", "status", F.lit(False).alias("word_only"))
    bad = cut(plain.unionByName(single).unionByName(holes))
    rows = texts.where(F.col("text").rlike(SUSPICIOUS)).select("table_name", "rec_id", F.explode(F.array_distinct(F.split("text", BLANKS))).alias("token")).where(F.col("token").rlike(SUSPICIOUS))
    hit = rows.join(bad, "token")
    if single_words:
        hit = hit.where(~F.col("word_only") | F.col("table_name").isin(*single_words))
    else:
        hit = hit.where(~F.col("word_only"))
    return hit.select("table_name", "rec_id", "token", "restored").distinct()


def restored_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, rec_id, text, restored, n_garbled, n_restored): found records with every
    known original put in; words that can't be restored stay as they are."""
    by = found.groupBy("table_name", "rec_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("restored", "token")))).alias("m"), F.count("*").alias("n_garbled"), F.count("restored").alias("n_restored"))
    t = texts.distinct().join(by, ["table_name", "rec_id"])
    pieces = F.regexp_extract_all("text", F.lit(r"[ \n\r\t]+|[^ \n\r\t]+"), F.lit(0))
    whole = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("m")[p], p)), "")
    return t.select("table_name", "rec_id", "text", whole.alias("restored"), "n_garbled", "n_restored")
