"""Queries of candidate analyses, relabelling passes and confidence over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.functions import text as t
from kilim.operators import confidence as conf
from kilim.operators import labeling as lab
from kilim.operators import rerank as rr
from kilim.plans.annotation import VOTES, corpus, corpus_tokens, low, lookups, q, sql_any, sql_cut, sql_labels, sql_map, sql_nominal_analysis
from kilim.plans.registry import query
from kilim.session import cut

CONTRACTION = sql_any(low("apo[2]"), ["s", "re", "ve", "m", "ll", "d", "t"])
FUSED = [s[::-1] for s, tag in m.by_suffix(m.FIRST_SINGULAR).items() if "|" in tag]
FORMS = "forms as (select distinct token from labs where shape is null)"


def sql_groups(rx: str, n: int, name: str) -> str:
    return ", ".join(f"regexp_extract(rs, {q(rx)}, {i}) as {name}{i}" for i in range(1, n + 1))


def sql_candidates(level: str, name: str, forms: str = "forms") -> str:
    """CTEs that end in `name`(token, stem, suffix, split, n_segments, n_features, source)."""
    return f"""{name}_s as (select token, unnest(range(2, length(token))) as split from {forms} where not regexp_matches(token, '[''’]')),
{name}_a as (select token, regexp_split_to_array(token, '[''’]') as apo from {forms} where regexp_matches(token, '[''’]')),
{name}_u as (select token, split::int as split, left(token, split::int) as stem, substr(token, split::int + 1) as suffix from {name}_s
  union all select token, length(apo[1]), apo[1], apo[2] from {name}_a where len(apo) = 2 and length(apo[1]) >= 2 and apo[2] <> '' and not {CONTRACTION}),
{name}_g as (select *, {sql_groups(m.NOMINAL, 5, 'g')}, {sql_groups(m.verbal_pattern(level), 3, 'v')} from (select *, reverse({low('suffix')}) as rs from {name}_u)),
{name}_c as (select *, {sql_cut('g1', m.STAGE_CASE)} as c, {sql_cut('g2', m.STAGE_POSSESSIVE)} as p, {sql_cut('g4', m.STAGE_DERIVATION)} as d from {name}_g),
{name} as (select token, stem, suffix, split, case when g5 = '' then 'nominal' else 'verbal' end as source,
  case when g5 = '' then len(c) + len(p) + (g3 <> '')::int + len(d) else (v1 <> '')::int + (v2 <> '')::int end as n_segments,
  case when g5 = '' then len(list_distinct(list_filter(string_split(array_to_string(list_transform(c, lambda x: {sql_map({**m.CASE, **m.BUFFER_N})}[x]) || list_transform(p, lambda x: coalesce({sql_map(m.POSSESSIVE)}[x], 'Amb')) || list_transform(d, lambda x: {sql_map(m.DERIVATION)}[x]) || [case when g3 <> '' then 'Number=Plur' else '' end], '|'), '|'), lambda x: x <> '')))
    else case when {sql_any('v1', FUSED)} then 2 else (v1 <> '')::int end + (v2 <> '')::int end as n_features
  from {name}_c where g5 = '' or (v3 = '' and v1 || v2 <> ''))"""


CANDS = sql_candidates("4c1", "cands")
BEST = """best as (select *, count(*) over (partition by token) as n_candidates from cands qualify row_number() over (partition by token order by n_segments desc, length(stem) desc, n_features desc, split) = 1)"""


def forms(spark: SparkSession, d: str) -> DataFrame:
    tok = corpus_tokens(spark, d)
    return tok.where(t.shape(F.col("token")).isNull()).select("token").distinct()


@query("candidate_analyses", f"with {sql_labels()}, {FORMS}, {CANDS} select * from cands")
def candidate_analyses(spark: SparkSession, d: str) -> DataFrame:
    c = rr.candidates(forms(spark, d))
    return c.select("token", "stem", "suffix", "split", "source", F.size("segments").alias("n_segments"), "n_features")


@query("best_analysis", f"with {sql_labels()}, {FORMS}, {CANDS}, {BEST} select token, stem, suffix, n_segments, source, n_candidates from best")
def best_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rr.best(rr.candidates(forms(spark, d))).select("token", "stem", "suffix", F.size("segments").alias("n_segments"), "source", "n_candidates")


GATE = f"""pairs as (select distinct token, label from labs),
gated as (select p.token, p.label, b.stem, b.suffix, b.source, b.n_segments, b.n_candidates, b.split, coalesce(l.en, false) as stem_en, coalesce(l.tr_all, false) as stem_tr,
  case when p.label = 'UID' then 'UID' when p.label = 'NE' and b.token is not null then 'NE_SUFFIX' when p.label = 'TR' and coalesce(l.en, false) then 'TR_SUSPECT_STEM' end as candidate_reason
  from pairs p left join best b on b.token = p.token and p.label in ('UID', 'NE', 'TR') left join lex l on l.word = {low('b.stem')})"""


def gated(spark: SparkSession, d: str) -> tuple[DataFrame, lab.Lookups]:
    look = lookups(spark, d)
    pairs = lab.label(corpus_tokens(spark, d), look).select("token", "label").distinct()
    return rr.gate(pairs, look), look


@query("candidate_gate", f"with {sql_labels()}, {FORMS}, {CANDS}, {BEST}, {GATE} select token, label, candidate_reason is not null as is_candidate, candidate_reason, stem from gated")
def candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d)[0].select("token", "label", "is_candidate", "candidate_reason", F.col("analysis.stem").alias("stem"))


@query(
    "structured_features",
    f"""with {sql_labels()}, {FORMS}, {CANDS}, {BEST}, {GATE} select token, label, length(token) as token_length, regexp_matches(token, '[''’]') as has_apostrophe, contains(token, '-') as has_hyphen, regexp_matches(token, '\\p{{Nd}}') as has_digit,
  regexp_matches(token, '^\\p{{Lu}}') as is_capitalized, regexp_matches(token, {q(rr.TURKISH_LETTERS)}) as has_turkish_letter, coalesce(w.tr_top, false) as in_tr_top, coalesce(w.tr_all, false) as in_tr_all, coalesce(w.en, false) as in_en,
  coalesce(length(stem), 0) as stem_length, coalesce(length(suffix), 0) as suffix_length, coalesce(n_segments, 0) as suffix_segment_count, stem is not null as fully_consumed_suffix, stem_en as stem_in_en, stem_tr as stem_in_tr_all,
  case when stem_en then 'lexicon_only' else 'none' end as stem_evidence_strength, coalesce(source, 'none') as analysis_source, coalesce(candidate_reason, 'none') as reason, coalesce(split::double / length(token), 0) as split_position_ratio, coalesce(n_candidates, 0) as analysis_candidate_count
  from gated left join lex w on w.word = {low('gated.token')}""",
)
def structured_features(spark: SparkSession, d: str) -> DataFrame:
    g, look = gated(spark, d)
    cols = ["token_length", "has_apostrophe", "has_hyphen", "has_digit", "is_capitalized", "has_turkish_letter", "in_tr_top", "in_tr_all", "in_en", "stem_length", "suffix_length", "suffix_segment_count", "fully_consumed_suffix", "stem_in_en", "stem_in_tr_all", "stem_evidence_strength", "analysis_source", "reason", "split_position_ratio", "analysis_candidate_count"]
    return rr.features(g, look).select("token", "label", *cols)


RES = f"""res_s as (select token, {low('token')} as l from forms where not (regexp_matches(token, '\\p{{Nd}}') or regexp_matches(token, '^\\p{{Lu}}')) and not regexp_matches(token, '[''’]')),
res_u as (select token, left(l, i::int) as stem, substr(l, i::int + 1) as suffix from (select token, l, unnest(range(2, length(l) - 1)) as i from res_s)),
res_h as (select *, reverse(suffix) as r0, regexp_extract(reverse(suffix), {q('^(' + m.reversed_any(m.by_suffix(m.FIRST_PLURAL)) + ')')}, 1) as head from res_u),
res_g as (select *, {sql_groups(m.verbal_pattern('4e', True), 3, 'v')} from (select *, substr(r0, length(head) + 1) as rs from res_h)),
res_f as (select g.*, v2 <> '' and not coalesce(tr_all, false) and coalesce(en, false) as fits from res_g g left join lex on word = stem where v3 = '' and head || v1 || v2 <> ''),
res_b as (select token, count(*) filter (where fits) as n_fit, arg_max(stem, length(stem)) filter (where fits) as stem, arg_max(suffix, length(stem)) filter (where fits) as suffix from res_f group by 1),
comp as (select distinct token from (select token, unnest(range(1, length(l) - 1)) as i, l from (select token, {low('token')} as l from forms)) join lex on word = left(l, i::int) and tr_all where regexp_extract(reverse(substr(l, i::int + 1)), {q(m.NOMINAL)}, 5) = ''),
resid as (select f.token, case when regexp_matches(f.token, '\\p{{Nd}}') or regexp_matches(f.token, '^\\p{{Lu}}') then 'proper_name_or_noise' when n_fit is null then 'no_verbal_candidate' when n_fit = 0 then 'no_qualifying_candidate'
  when c.token is not null then 'competing_nominal_analysis' else 'promoted' end as reason, b.stem, b.suffix from forms f left join res_b b using (token) left join comp c on c.token = f.token)"""


@query("residual_verbal", f"with {sql_labels()}, {FORMS}, {RES} select token, reason = 'promoted' as promote, reason, case when reason = 'promoted' then stem end as stem, case when reason = 'promoted' then suffix end as suffix from resid")
def residual_verbal(spark: SparkSession, d: str) -> DataFrame:
    return rr.residual(forms(spark, d), lookups(spark, d))


RESOLVE = f"""{sql_candidates('4e', 'wide')}, rooted as (select w.token, bool_or(coalesce(l.en, false)) as english_root from wide w left join lex l on l.word = {low('w.stem')} group by 1),
tstem as (select c.token, arg_min(c.stem, c.split) as turkish_stem from cands c join lex l on l.word = {low('c.stem')} and l.tr_all where c.source = 'nominal' group by 1),
solved as (select f.token, case when length(f.token) < 2 then 'too_short' when regexp_matches(f.token, {q(rr.EMAIL)}) then 'email' when regexp_matches(f.token, '[''’]') then 'apostrophe'
  when regexp_matches(f.token, '\\p{{Lu}}') and not regexp_matches(f.token, '\\p{{Ll}}') and length(f.token) > 1 then 'all_caps_acronym' when regexp_matches(f.token, '\\p{{Nd}}') then 'alphanumeric_identifier' when regexp_matches(f.token, '^\\p{{Lu}}') then 'probable_proper_name'
  when coalesce(w.en, false) then 'strong_direct_english_match' when coalesce(english_root, false) then 'english_root_turkish_suffix_analysis' else 'eligible' end as reason,
  coalesce(w.tr_all, false) or turkish_stem is not null as trusted, {sql_nominal_analysis('f.token')} as chain, regexp_matches(f.token, {q(rr.TURKISH_LETTERS)}) as ortho
  from forms f left join rooted using (token) left join tstem using (token) left join lex w on w.word = {low('f.token')}),
decided as (select *, reason = 'eligible' as ok, case when reason = 'eligible' then 3 * trusted::int + 3 * chain::int + 2 * ortho::int else 0 end as score from solved)"""


@query("uid_resolver", f"with {sql_labels()}, {FORMS}, {CANDS}, {RESOLVE} select token, score, ok and trusted::int + chain::int + ortho::int >= 2 and score >= 7 as promote, case when not ok then reason when trusted::int + chain::int + ortho::int >= 2 and score >= 7 then 'promoted' else 'ambiguous_or_insufficient_evidence' end as reason from decided")
def uid_resolver(spark: SparkSession, d: str) -> DataFrame:
    return rr.decide(rr.resolver(forms(spark, d), lookups(spark, d))).select("token", "score", "promote", "reason")


PASSES = f"""final as (select l.doc_id, l.sent_no, l.pos, l.token, l.shape, l.label as rule_label, v.matrix_lang as old_matrix, v.embed_lang as old_embed, r.reason as residual_reason,
  case when l.label in ('UID', 'TR') and r.reason = 'promoted' then 'MIXED' when l.label = 'UID' and s.ok and s.trusted::int + s.chain::int + s.ortho::int >= 2 and s.score + (v.matrix_lang = 'TR')::int >= 7 then 'TR' else l.label end as label,
  case when l.label = 'UID' and coalesce(r.reason <> 'promoted', true) then case when s.ok then s.score + (v.matrix_lang = 'TR')::int else 0 end end as resolver_score
  from labs l join votes v using (doc_id, sent_no) left join resid r on r.token = l.token and l.label in ('UID', 'TR') left join decided s on s.token = l.token and l.label = 'UID')"""


def relabelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, lab.Lookups]:
    look = lookups(spark, d)
    tok, votes = lab.annotate(corpus(spark, d), look)
    return *rr.passes(tok, votes, look, model=rr.unsure), look


@query("relabel_passes", f"with {sql_labels()}, {VOTES}, {FORMS}, {CANDS}, {RES}, {RESOLVE}, {PASSES} select rule_label, label, count(*) as n from final group by 1, 2")
def relabel_passes(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(spark, d)[0].groupBy("rule_label", "label").agg(F.count("*").alias("n"))


REVOTE = """rev as (select doc_id, sent_no, count(*) filter (where label = 'TR') as tr, count(*) filter (where label = 'EN') as en, count(*) filter (where label = 'MIXED') as mx, bool_or(label <> rule_label) as changed from final group by 1, 2),
nv as (select v.doc_id, v.sent_no, coalesce(changed, false) as changed, case when coalesce(changed, false) then case when tr + 0.6::double * mx >= en + 0.4::double * mx then 'TR' else 'EN' end else matrix_lang end as matrix_lang,
  case when coalesce(changed, false) then case when tr + 0.6::double * mx >= en + 0.4::double * mx then case when en + mx > 0 then 'EN' else '-' end else case when tr + mx > 0 then 'TR' else '-' end end else embed_lang end as embed_lang from votes v left join rev using (doc_id, sent_no))"""


@query("revote_changed", f"with {sql_labels()}, {VOTES}, {FORMS}, {CANDS}, {RES}, {RESOLVE}, {PASSES}, {REVOTE} select matrix_lang, embed_lang, changed, count(*) as n from nv group by 1, 2, 3")
def revote_changed(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(spark, d)[1].groupBy("matrix_lang", "embed_lang", "changed").agg(F.count("*").alias("n"))


CONF = f"""cf as (select f.*, n.matrix_lang, n.embed_lang, coalesce(w.tr_top, false) as top, coalesce(w.tr_all, false) as al, coalesce(w.en, false) as en, {sql_nominal_analysis('f.token')} as suf, regexp_matches(f.token, {q(rr.TURKISH_LETTERS)}) as ort
  from final f join nv n using (doc_id, sent_no) left join lex w on w.word = k0),
c1 as (select *, case label when 'OTHER' then 0.98::double when 'TR' then least(case when top then 0.9::double when al then 0.8::double else 0.3::double end + case when suf then 0.05::double else 0 end + case when ort then 0.03::double else 0 end - case when en then 0.25::double else 0 end, case when rule_label = 'UID' then 0.8::double else 9 end)
  when 'EN' then case when en then 0.85::double else 0.3::double end - case when top or al then 0.3::double else 0 end - case when suf then 0.1::double else 0 end
  when 'MIXED' then case when rule_label = 'MIXED' then 0.88::double else 0.72::double end
  when 'UID' then least(0.75::double, 0.5::double + case when resolver_score >= 5 then -0.15::double when resolver_score = 0 then 0.05::double else 0 end - case when residual_reason not in ('promoted', 'no_verbal_candidate', 'proper_name_or_noise') then 0.05::double else 0 end + case when not (top or al) and not en and not suf then 0.05::double else 0 end) end as s0 from cf),
cs as (select *, greatest(0::double, least(1::double, case when (label = 'EN' and matrix_lang = 'TR' and embed_lang not in ('', 'EN')) or (label = 'TR' and matrix_lang = 'EN' and embed_lang not in ('', 'TR')) then s0 - 0.05::double else s0 end)) as score from c1)"""
PASSES_K = PASSES.replace("l.label as rule_label,", f"l.label as rule_label, {low('l.token')} as k0,")
CONF_ALL = f"{sql_labels()}, {VOTES}, {FORMS}, {CANDS}, {RES}, {RESOLVE}, {PASSES_K}, {REVOTE}, {CONF}"
BAND = "case when score >= 0.85::double then 'HIGH' when score >= 0.60::double then 'MEDIUM' else 'LOW' end"


def confident(spark: SparkSession, d: str) -> DataFrame:
    tok, votes, look = relabelled(spark, d)
    if "flags" not in tok.columns:
        tok = look.flags(tok, F.lower("token"), "flags")
    return conf.scored(tok.join(votes.select("doc_id", "sent_no", "matrix_lang", "embed_lang"), ["doc_id", "sent_no"]))


@query("confidence_scores", f"with {CONF_ALL} select doc_id, sent_no, pos, label, round(score, 6) as score, {BAND} as band from cs")
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return confident(spark, d).select("doc_id", "sent_no", "pos", "label", F.round("score", 6).alias("score"), "band")


@query("confidence_bands", f"with {CONF_ALL} select label, {BAND} as band, count(*) as n from cs group by 1, 2")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return confident(spark, d).groupBy("label", "band").agg(F.count("*").alias("n"))


@query("review_queue", f"with {CONF_ALL} select doc_id, sent_no, pos, token, label from cs where score < 0.85::double and label in ('EN', 'MIXED')")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return conf.review_queue(cut(confident(spark, d)), labels=("EN", "MIXED")).select("doc_id", "sent_no", "pos", "token", "label")
