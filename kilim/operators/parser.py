"""Hierarchical morphological parse: the best of structured verbs, enumerated chains and the
whole token, by an additive score.

Structured endings are a small literal table joined on the ending; scores are expressions;
the choice is one max_by per form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.operators.labeling import Lookups
from kilim.operators.rerank import candidates

ROOT_LEAST, VERBAL_ROOT_LEAST, MARGIN = 2, 3, 50.0
FRONT, BACK = "eiöü", "aıou"
# Tense endings by category, and the persons that may follow them.
TENSES = {"past_definite": "dı di du dü tı ti tu tü", "evidential_past": "mış miş muş müş", "progressive": "ıyor iyor uyor üyor", "future": "acak ecek yacak yecek"}
PERSONS = {
    "first_singular": ("m", "past_definite evidential_past"),
    "second_singular": ("n", "past_definite evidential_past"),
    "first_plural": ("k", "past_definite evidential_past"),
    "second_plural": ("sınız siniz sunuz sünüz", "past_definite evidential_past progressive future"),
    "third_plural": ("lar ler", "past_definite evidential_past progressive future"),
}


def endings() -> list[tuple[str, list[str], list[str]]]:
    """(ending, segments, categories) of every tense with or without a person."""
    out = []
    for cat, forms in TENSES.items():
        for f in forms.split():
            out.append((f, [f], [cat]))
            for person, (ps, after) in PERSONS.items():
                if cat in after.split():
                    out += [(f + p, [f, p], [cat, person]) for p in ps.split()]
    return out


def harmony(stem: Column, segment: Column) -> Column:
    """Whether the stem's last and the segment's first vowel are both front or both back; null
    without a vowel on either side."""
    a = F.regexp_extract(F.lower(stem), rf"([{FRONT}{BACK}])[^{FRONT}{BACK}]*$", 1)
    b = F.regexp_extract(F.lower(segment), rf"^[^{FRONT}{BACK}]*([{FRONT}{BACK}])", 1)
    return F.when((a != "") & (b != ""), a.isin(*FRONT) == b.isin(*FRONT))


def segment_category(segment: Column) -> Column:
    """Category of a nominal segment, by the first table that has it."""
    known: dict[str, str] = {}
    for table in (m.BUFFER_N, m.CASE, {s: t for s, t in m.POSSESSIVE.items() if len(s) == 4}, {s: t for s, t in m.POSSESSIVE.items() if len(s) < 4}, {s: "Number=Plur" for s in m.PLURAL.split()}, m.DERIVATION, {s: "Amb=P3sg_or_Acc" for s in m.AMBIGUOUS.split()}):
        for s, t in table.items():
            known.setdefault(s, t.replace("|", "+"))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(segment)), F.lit("unrecognized"))


def pool(forms: DataFrame) -> DataFrame:
    """(token, stem, segments, source, ord) of all candidates; ord keeps their order."""
    f = forms.select("token").where("token is not null and trim(token) <> ''").distinct()
    low, n = F.lower("token"), F.length(F.lower(F.col("token")))
    table = {}
    for e, segs, _ in endings():
        table.setdefault(len(e), {}).setdefault(e, segs)
    tries = [F.when((n - k >= ROOT_LEAST), F.struct(F.left(low, F.greatest(n - k, F.lit(0))).alias("stem"), F.try_element_at(F.create_map(*[x for e, s in es.items() for x in (F.lit(e), F.array(*map(F.lit, s)))]), F.right(low, F.lit(k))).alias("segments"))) for k, es in sorted(table.items())]
    verbs = f.select("token", F.explode(F.filter(F.array(*tries), lambda x: x["segments"].isNotNull())).alias("x"))
    verbs = verbs.select("token", "x.stem", "x.segments", F.lit("verb_structured").alias("source"), F.length("x.stem").alias("ord"))
    chains = candidates(f, "4e").where(F.length("stem") >= F.when(F.col("source") == "verbal", VERBAL_ROOT_LEAST).otherwise(ROOT_LEAST))
    chains = chains.select("token", "stem", "segments", "source", (F.col("split") + 100_000).alias("ord"))
    whole = f.select("token", F.col("token").alias("stem"), F.array().cast("array<string>").alias("segments"), F.lit("full_token").alias("source"), F.lit(1_000_000).alias("ord"))
    return verbs.unionByName(chains).unionByName(whole)


def score(flags: str = "f") -> Column:
    top, all_, en = (F.col(f"{flags}.{k}") for k in ("top", "all", "en"))
    valid = F.size(F.filter("segments", lambda s: segment_category(s) != "unrecognized"))
    s = F.when(top, 1000.0).when(all_, 500.0).otherwise(0.0) + F.when(en & ~all_ & ~top, 400.0).otherwise(0.0)
    s = s + F.when(F.col("source") == "verb_structured", 300.0).when(F.col("source") == "verbal", 200.0).when(F.col("source") == "nominal", valid * 90.0).otherwise(0.0)
    s = s + F.length("stem") * 10.0 - F.size(F.filter("segments", lambda x: F.length(x) == 1)) * 50.0
    return s + F.when(F.col("harmony"), 10.0).when(~F.col("harmony"), -5.0).otherwise(0.0)


def parse(forms: DataFrame, look: Lookups) -> DataFrame:
    """(token, root, segments, source, category, pos, success, harmony, score): null and blank
    tokens have no row. The highest score counts, then the longer stem, then the earlier
    candidate; a parse that doesn't give the token back or has no known root and no suffix fails."""
    p = look.flags(pool(forms), F.lower("stem"), "f")
    p = p.withColumn("harmony", harmony(F.col("stem"), F.get("segments", F.lit(0)))).withColumn("score", score())
    key = F.struct("score", F.length("stem").alias("n"), (-F.col("ord")).alias("o"))
    whole = F.when(F.col("source") == "full_token", F.struct("score", (F.col("f.top") | F.col("f.all") | F.col("f.en")).alias("known")))
    b = p.groupBy("token").agg(F.max_by(F.struct("stem", "segments", "source", "f", "harmony", "score"), key).alias("b"), F.max(whole).alias("w")).select("token", "b.*", "w")
    turkish, english = F.col("f.top") | F.col("f.all"), F.col("f.en")
    cat = F.when(turkish, "full_turkish_lexical_item").when(english, "english_root_turkish_suffix").when(F.size("segments") > 0, "ambiguous_candidate").otherwise("invalid_parser_proposal")
    close = (F.size("segments") > 0) & (turkish | english) & F.col("w.known") & (F.col("score") - F.col("w.score") < MARGIN)
    back = F.lower(F.concat("stem", F.array_join("segments", ""))) == F.lower("token")
    ok = back & ((F.size("segments") > 0) | turkish | english)
    pos = F.when(F.col("source").isin("verb_structured", "verbal"), "verb").when(F.col("source") == "nominal", "noun").otherwise("unknown")
    none = F.array().cast("array<string>")
    return b.select(
        "token", F.when(ok, F.col("stem")).otherwise(F.col("token")).alias("root"), F.when(ok, F.col("segments")).otherwise(none).alias("segments"),
        F.when(~ok, "whole_token_fallback").when((F.col("source") == "full_token"), "full_lexical_item").otherwise(F.col("source")).alias("source"),
        F.when(~ok, "invalid_parser_proposal").when(close, "ambiguous_candidate").otherwise(cat).alias("category"),
        F.when(ok, pos).otherwise("unknown").alias("pos"), ok.alias("success"), F.when(ok, F.col("harmony")).alias("harmony"), F.col("score"),
    )


def explanations(parsed: DataFrame) -> DataFrame:
    """parsed with `explained`: (segment, category) of each segment."""
    verb = F.create_map(*[x for e, s, c in endings() if len(s) == 1 for x in (F.lit(e), F.lit(c[0]))])
    one = lambda s: F.struct(s.alias("segment"), F.when(F.col("source") == "verb_structured", F.coalesce(F.try_element_at(verb, s), F.lit("person"))).when(F.col("source") == "verbal", "Verbal").otherwise(segment_category(s)).alias("category"))
    return parsed.withColumn("explained", F.transform("segments", one))
