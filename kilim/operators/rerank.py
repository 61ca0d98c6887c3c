"""Candidate analyses of tokens, the candidate gate, and the relabelling passes after the rules.

Token-only work runs on distinct forms: splits are exploded there, filtered at once to those
with a valid suffix chain, and joined back by form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.functions import text as t
from kilim.operators.labeling import Config, Lookups, sentence_votes
from kilim.session import cut

STEM_LEAST, RECOVERY_STEM_LEAST = 2, 5
STRATEGIES = ("highest_suffix_segments", "longest_stem", "longest_suffix")
TURKISH_LETTERS = "[çÇğĞıİöÖşŞüÜ]"
# Weights of the resolver's signals, in order.
SIGNALS = (("trusted_lexicon", 3), ("suffix_chain", 3), ("lid_strong", 3), ("orthographic", 2), ("matrix_language", 1))
PRIMARY_LEAST, PROMOTE_FROM, EMAIL = 2, 7, r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def candidates(forms: DataFrame, level: str = "4c1", informal: bool = False, token: str = "token") -> DataFrame:
    """(token, stem, suffix, split, segments, tags, n_features, source) for every split whose
    suffix is a nominal chain without leftover, else a verbal chain read whole. Tokens with an
    apostrophe have its one split. Null and short tokens have none."""
    forms, tok = forms.select(F.col(token).alias("token")), F.col("token")
    apo = t.apostrophe_parts(tok)
    n = F.length(tok)
    splits = F.when(n > STEM_LEAST, F.transform(F.sequence(F.lit(STEM_LEAST), F.greatest(n - 1, F.lit(STEM_LEAST))), lambda i: F.struct(i.alias("split"), F.left(tok, i).alias("stem"), F.substr(tok, i + 1).alias("suffix"))))
    one = F.when(apo.isNotNull() & (F.length(apo["base"]) >= STEM_LEAST), F.array(F.struct(F.length(apo["base"]).alias("split"), apo["base"].alias("stem"), apo["suffix"].alias("suffix"))))
    e = forms.select("token", F.explode(F.when(tok.rlike("['’]"), one).otherwise(splits)).alias("s")).select("token", "s.*")
    e = e.withColumns({"n": m.nominal(F.col("suffix")), "v": m.verbal(F.col("suffix"), level, informal)})
    nominal = ~F.array_contains("n.deriv", m.LEFTOVER) & (F.size("n.ud") + F.size("n.deriv") + F.size("n.amb") > 0)
    verbal = F.col("v.whole") & (F.size("v.tags") > 0)
    e = e.withColumn("source", F.when(nominal, "nominal").when(verbal, "verbal")).where("source is not null")
    nom = F.col("source") == "nominal"
    return e.select(
        "token", "stem", "suffix", "split",
        F.when(nom, F.col("n.segments")).otherwise(F.col("v.segments")).alias("segments"),
        F.when(nom, F.concat("n.ud", "n.deriv", "n.amb")).otherwise(F.col("v.tags")).alias("tags"),
        F.when(nom, F.size("n.ud") + F.size("n.deriv") + F.size("n.amb")).otherwise(F.size("v.tags")).alias("n_features"),
        "source",
    )


def strategy_key(strategy: str) -> Column:
    keys = {"highest_suffix_segments": (F.size("segments"), F.length("stem")), "longest_stem": (F.length("stem"), F.size("segments")), "longest_suffix": (F.length("suffix"), F.size("segments"))}
    if strategy not in keys:
        raise ValueError(f"unknown strategy: {strategy}; one of {STRATEGIES}")
    a, b = keys[strategy]
    return F.struct(a.alias("a"), b.alias("b"), F.col("n_features").alias("c"), (-F.col("split")).alias("d"))


def best(cands: DataFrame, strategy: str = STRATEGIES[0]) -> DataFrame:
    """(token, stem, suffix, ..., n_candidates, unique): the best analysis of each token."""
    key = strategy_key(strategy)
    cols = [c for c in cands.columns if c != "token"]
    g = cands.groupBy("token").agg(F.max_by(F.struct(*cols), key).alias("b"), F.count("*").alias("n_candidates"), F.count_distinct("source").alias("n_sources"))
    return g.select("token", "b.*", "n_candidates", (F.col("n_sources") > 1).alias("competition"))


def recovered_stem(stems: DataFrame, look: Lookups) -> DataFrame:
    """(stem, recovered): the first doubling of a consonant that gives an English word."""
    s = F.col("stem")
    pos = F.filter(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)).rlike(r"\p{L}") & ~F.substr(s, i, F.lit(1)).rlike("[aeiou]"))
    v = stems.where(F.length("stem") >= RECOVERY_STEM_LEAST).select("stem", F.explode(F.transform(pos, lambda i: F.struct(i.alias("i"), F.lower(F.concat(F.left(s, i), F.substr(s, i, F.lit(1)), F.substr(s, i + 1))).alias("v")))).alias("x"))
    v = look.flags(v, F.col("x.v"), "f").where("f.en")
    return v.groupBy("stem").agg(F.min_by("x.v", "x.i").alias("recovered"))


def gate(labelled: DataFrame, look: Lookups, level: str = "4c1", informal: bool = False, recovery: bool = False) -> DataFrame:
    """labelled (token, label, ...) with is_candidate, candidate_reason and the best analysis:
    UID always, NE with an analysis, TR with an English stem (or a recovered one)."""
    forms = labelled.where(F.col("label").isin("UID", "NE", "TR")).select("token").distinct()
    b = best(candidates(forms, level, informal))
    b = look.flags(b, F.lower("stem"), "stem_flags")
    b = b.withColumn("stem_english", F.col("stem_flags.en") | F.col("stem_flags.lid_en"))
    if recovery:
        b = b.join(recovered_stem(b.select("stem").distinct(), look), "stem", "left").withColumn("stem_english", F.col("stem_english") | F.col("recovered").isNotNull())
    j = labelled.join(b.select("token", F.struct(*[c for c in b.columns if c != "token"]).alias("analysis")), "token", "left")
    a = F.col("analysis")
    why = F.when(F.col("label") == "UID", "UID").when((F.col("label") == "NE") & a.isNotNull(), "NE_SUFFIX").when((F.col("label") == "TR") & F.coalesce(a["stem_english"], F.lit(False)), "TR_SUSPECT_STEM")
    keep = F.col("label").isin("UID", "NE", "TR")
    return j.withColumns({"is_candidate": why.isNotNull(), "candidate_reason": why, "analysis": F.when(keep, a)})


def features(gated: DataFrame, look: Lookups) -> DataFrame:
    """The structured features of gated rows as columns: form, lexicon, stem and selection."""
    tok, a = F.col("token"), F.col("analysis")
    g = gated if "flags" in gated.columns else look.flags(gated, F.lower("token"), "flags")
    z = lambda c, v: F.coalesce(c, F.lit(v))
    strength = F.when(z(a["stem_flags"]["en"], False) & z(a["stem_flags"]["lid_en"], False), "both").when(z(a["stem_flags"]["en"], False), "lexicon_only").when(z(a["stem_flags"]["lid_en"], False), "lid_only").otherwise("none")
    f = {
        "token_length": F.length(tok), "has_apostrophe": tok.rlike("['’]"), "has_hyphen": F.contains(tok, F.lit("-")), "has_digit": tok.rlike(r"\p{Nd}"),
        "is_capitalized": tok.rlike(r"^\p{Lu}"), "has_turkish_letter": tok.rlike(TURKISH_LETTERS), "in_tr_top": F.col("flags.top"), "in_tr_all": F.col("flags.all"), "in_en": F.col("flags.en"),
        "stem_length": z(F.length(a["stem"]), 0), "suffix_length": z(F.length(a["suffix"]), 0), "suffix_segment_count": z(F.size(a["segments"]), 0), "fully_consumed_suffix": a.isNotNull(),
        "stem_in_tr_top": z(a["stem_flags"]["top"], False), "stem_in_tr_all": z(a["stem_flags"]["all"], False), "stem_in_en": z(a["stem_flags"]["en"], False), "stem_evidence_strength": strength,
        "analysis_source": z(a["source"], "none"), "reason": z(F.col("candidate_reason"), "none"), "split_position_ratio": F.when(a.isNotNull(), a["split"] / F.length(tok)).otherwise(0.0),
        "analysis_candidate_count": z(a["n_candidates"], 0).cast("int"), "nominal_verbal_competition": z(a["competition"], False),
        "morph_tag_count": z(a["n_features"], 0), "has_case": z(F.exists(a["tags"], lambda x: F.startswith(x, F.lit("Case="))), False), "has_plural": z(F.array_contains(a["tags"], "Number=Plur"), False),
    }
    return g.withColumns(f)


def noise(token: Column) -> Column:
    """Names and noise: any OTHER shape, digits, a capital at the start."""
    return t.shape(token).isNotNull() | token.rlike(r"\p{Nd}") | token.rlike(r"^\p{Lu}")


def competing_nominal(forms: DataFrame, look: Lookups) -> DataFrame:
    """(token) with a nominal chain of two letters or more behind a Turkish lexicon word."""
    low = F.lower("token")
    n = F.length(low)
    s = forms.where(n > 2).select("token", F.explode(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.left(low, i).alias("stem"), F.substr(low, i + 1).alias("suffix")))).alias("s"))
    s = look.flags(s, F.col("s.stem"), "f").where(F.col("f.all") | F.col("f.top"))
    s = s.withColumn("n", m.nominal(F.col("s.suffix")))
    return s.where(~F.array_contains("n.deriv", m.LEFTOVER) & (F.size("n.ud") + F.size("n.deriv") + F.size("n.amb") > 0)).select("token").distinct()


def residual(forms: DataFrame, look: Lookups) -> DataFrame:
    """(token, promote, reason, stem, suffix): verbal forms of English stems that no rule finds."""
    f = forms.select("token").distinct()
    low, n = F.lower("token"), F.length(F.lower(F.col("token")))
    s = f.where(~noise(F.col("token")) & ~F.col("token").rlike("['’]") & (n > STEM_LEAST))
    s = s.select("token", F.explode(F.transform(F.sequence(F.lit(STEM_LEAST), F.greatest(n - 2, F.lit(STEM_LEAST))), lambda i: F.struct(F.left(low, i).alias("stem"), F.substr(low, i + 1).alias("suffix")))).alias("s")).select("token", "s.*")
    s = s.where(F.length("stem") <= F.length("token") - 2).withColumn("v", m.verbal(F.col("suffix"), "4e", informal=True, plural_first=True)).where("v.whole and size(v.tags) > 0")
    s = look.flags(s, F.col("stem"), "f")
    fits = F.exists("v.tags", lambda x: x.isin("Verbal=Verbalizer", "Verbal=PassiveInchoative")) & ~F.col("f.all") & ~F.col("f.top") & F.col("f.en")
    g = s.groupBy("token").agg(F.max_by(F.when(fits, F.struct("stem", "suffix")), F.when(fits, F.length("stem"))).alias("b"), F.count(F.when(fits, 1)).alias("n_fit"))
    against = competing_nominal(f, look).withColumn("competing", F.lit(True))
    j = f.join(g, "token", "left").join(against, "token", "left")
    why = F.when(noise(F.col("token")), "proper_name_or_noise").when(F.col("n_fit").isNull(), "no_verbal_candidate").when(F.col("n_fit") == 0, "no_qualifying_candidate").when(F.col("competing"), "competing_nominal_analysis").otherwise("promoted")
    return j.select("token", (why == "promoted").alias("promote"), why.alias("reason"), F.when(why == "promoted", F.col("b.stem")).alias("stem"), F.when(why == "promoted", F.col("b.suffix")).alias("suffix"))


def resolver(forms: DataFrame, look: Lookups) -> DataFrame:
    """(token, eligible, reason, trusted_lexicon, suffix_chain, lid_strong, orthographic) of
    tokens labelled UID, whatever their sentence."""
    f = forms.select("token").distinct()
    tok = F.col("token")
    wide = look.flags(candidates(f, "4e"), F.lower("stem"), "s")
    rooted = wide.groupBy("token").agg(F.max(F.col("s.en") | F.col("s.lid_en")).alias("english_root"))
    narrow = look.flags(candidates(f).where("source = 'nominal'"), F.lower("stem"), "s").where("s.all or s.top")
    stem = narrow.groupBy("token").agg(F.min_by("stem", "split").alias("turkish_stem"))
    j = look.flags(f.join(rooted, "token", "left").join(stem, "token", "left"), F.lower("token"), "flags")
    caps = tok.rlike(r"\p{Lu}") & ~tok.rlike(r"\p{Ll}") & (F.length(tok) > 1)
    why = (
        F.when(F.length(tok) < 2, "too_short").when(t.shape(tok).isNotNull(), "other_token").when(tok.rlike(EMAIL), "email").when(tok.rlike("['’]"), "apostrophe").when(caps, "all_caps_acronym")
        .when(tok.rlike(r"\p{Nd}"), "alphanumeric_identifier").when(tok.rlike(r"^\p{Lu}"), "probable_proper_name").when(F.col("flags.en"), "strong_direct_english_match")
        .when(F.coalesce("english_root", F.lit(False)), "english_root_turkish_suffix_analysis").otherwise("eligible")
    )
    known = F.col("flags.all") | F.col("flags.top")
    return j.select("token", (why == "eligible").alias("eligible"), why.alias("reason"), (known | F.col("turkish_stem").isNotNull()).alias("trusted_lexicon"), m.has_nominal_analysis(tok).alias("suffix_chain"), F.col("flags.lid_tr").alias("lid_strong"), tok.rlike(TURKISH_LETTERS).alias("orthographic"), "turkish_stem")


def decide(resolved: DataFrame, matrix: Column | None = None) -> DataFrame:
    """resolved with evidence, score and promote; matrix: the sentence's language, if known."""
    on = {**{s: F.col(s) for s, _ in SIGNALS[:4]}, "matrix_language": F.coalesce(matrix == "TR", F.lit(False)) if matrix is not None else F.lit(False)}
    ev = F.filter(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(w).alias("weight"), on[s].alias("on")) for s, w in SIGNALS]), lambda x: x["on"])
    r = resolved.withColumn("evidence", F.when(F.col("eligible"), ev).otherwise(F.filter(ev, lambda x: F.lit(False))))
    score = F.aggregate("evidence", F.lit(0), lambda a, x: a + x["weight"])
    primary = F.size(F.filter("evidence", lambda x: x["signal"] != "matrix_language"))
    r = r.withColumn("score", score)
    ok = F.col("eligible") & (primary >= PRIMARY_LEAST) & (F.col("score") >= PROMOTE_FROM)
    why = F.when(ok, "promoted").when(F.col("eligible"), "ambiguous_or_insufficient_evidence").otherwise(F.col("reason"))
    return r.withColumns({"promote": ok, "reason": why})


def explain(token: Column, promote: Column, score: Column, evidence: Column, reason: Column) -> Column:
    lines = F.when(F.size(evidence) > 0, F.array_join(F.transform(evidence, lambda x: F.concat(F.lit("- "), x["signal"])), "\n")).otherwise("- (none)")
    return F.concat(F.lit("Token: "), token, F.lit("\nCurrent: UID\nProposed: "), F.when(promote, "TR").otherwise("UID"), F.lit("\nScore: "), score.cast("string"), F.lit("\nEvidence:\n"), lines, F.lit("\nDecision: "), F.when(promote, "promote").otherwise("retain"), F.lit(" ("), reason, F.lit(")"))


def unsure(gated: DataFrame) -> DataFrame:
    """A model without an opinion, so that the passes behind the reranker stand alone; it is
    asked about no row."""
    return gated.withColumn("prob", F.lit(None).cast("double"))


def passes(labelled: DataFrame, votes: DataFrame, look: Lookups, model=None, threshold: float = 0.85, keys: tuple[str, ...] = ("doc_id", "sent_no"), config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(tokens with rule_label, label, promoted_by; votes), written between the passes: the reranker, the residual verbal
    pass and the resolver in turn, each over the label as it then stands; the resolver uses the
    matrix language from before. Sentences are voted anew where a label changed.

    model: a function of gated rows that adds `prob`. Without one nothing is relabelled, by any
    of the passes: labels and votes stay as they are.
    """
    df = cut(labelled).withColumnRenamed("label", "rule_label")
    votes = cut(votes)
    step = df.withColumn("label", F.col("rule_label"))
    if model is None:
        none = {c: F.lit(None).cast(k) for c, k in (("prob", "double"), ("promoted_by", "string"), ("residual_reason", "string"), ("resolver_score", "int"), ("resolver_reason", "string"))}
        return step.withColumns(none), votes.withColumn("changed", F.lit(False))
    step = unsure(step.withColumns({"is_candidate": F.lit(False), "candidate_reason": F.lit(None), "analysis": F.lit(None)})) if model is unsure else model(gate(step, look))
    up = F.coalesce(F.col("is_candidate") & (F.col("prob") >= threshold), F.lit(False))
    step = step.withColumn("label", F.when(up, "MIXED").otherwise(F.col("label"))).drop("is_candidate", "candidate_reason", "analysis")
    by = F.when(F.col("label") != F.col("rule_label"), "reranker")
    step = step.withColumn("promoted_by", by)
    forms = lambda d, *labels: d.where(F.col("label").isin(*labels)).select("token").distinct()
    r = cut(residual(forms(step, "UID", "TR"), look).select("token", F.col("promote").alias("r_up"), F.col("reason").alias("residual_reason")))
    step = step.join(r, "token", "left")
    up = F.col("label").isin("UID", "TR") & F.coalesce("r_up", F.lit(False))
    step = step.withColumns({"promoted_by": F.when(up, "residual").otherwise(F.col("promoted_by")), "label": F.when(up, "MIXED").otherwise(F.col("label"))}).drop("r_up")
    step = step.join(votes.select(*keys, F.col("matrix_lang").alias("__m")), list(keys), "left")
    d = cut(resolver(forms(step, "UID"), look).withColumnRenamed("reason", "why"))
    step = step.join(d, "token", "left")
    step = decide(step.withColumnRenamed("why", "reason").withColumn("eligible", F.coalesce("eligible", F.lit(False)) & (F.col("label") == "UID")), F.col("__m"))
    up = (F.col("label") == "UID") & F.coalesce("promote", F.lit(False))
    step = step.withColumns({"promoted_by": F.when(up, "resolver").otherwise(F.col("promoted_by")), "label": F.when(up, "TR").otherwise(F.col("label")), "resolver_score": F.col("score"), "resolver_reason": F.col("reason")})
    out = step.drop("__m", "eligible", "reason", *[s for s, _ in SIGNALS[:4]], "turkish_stem", "evidence", "score", "promote")
    out = cut(out)
    new = sentence_votes(out, keys, config)
    changed = out.groupBy(*keys).agg(F.max(F.col("label") != F.col("rule_label")).alias("changed"))
    v = votes.join(new.select(*keys, F.col("matrix_lang").alias("nm"), F.col("embed_lang").alias("ne")), list(keys), "left").join(changed, list(keys), "left")
    c = F.coalesce("changed", F.lit(False))
    v = v.withColumns({"matrix_lang": F.when(c, F.col("nm")).otherwise(F.col("matrix_lang")), "embed_lang": F.when(c, F.col("ne")).otherwise(F.col("embed_lang")), "changed": c}).drop("nm", "ne")
    return out, v
