"""Queries of the morphological parser and dictionary lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.operators import dictionary as dic
from kilim.operators import parser as ps
from kilim.plans.annotation import low, lookups, q, sql_labels
from kilim.plans.registry import query
from kilim.plans.rerank import FORMS, forms, sql_candidates, sql_cut, sql_groups
from kilim.sources.tables import table

ENDS = ps.endings()
END_VALUES = ", ".join(f"({q(e)}, {q(s[0])}, {q(s[1] if len(s) > 1 else '')}, {len(s)})" for e, s, _ in {e: (e, s, c) for e, s, c in reversed(ENDS)}.values())
F_, B_ = ps.FRONT, ps.BACK
WIDE = sql_candidates("4e", "wide")
FIRST = f"""segd as (select w.*, {sql_groups(m.NOMINAL, 5, 'g')}, {sql_groups(m.verbal_pattern('4e'), 3, 'v')}, rs from (select *, reverse({low('suffix')}) as rs from wide) w),
segs as (select *, case when source = 'nominal' then list_transform(list_reverse(list_filter({sql_cut('g1', m.STAGE_CASE)} || {sql_cut('g2', m.STAGE_POSSESSIVE)} || [g3] || {sql_cut('g4', m.STAGE_DERIVATION)}, lambda x: x <> '')), lambda x: reverse(x))
   else list_transform(list_reverse(list_filter([regexp_extract(v1, {q('^((?:' + m.informal_any(m.LEVELS['4e'].agreement, False) + ')?)')}, 1), substr(v1, length(regexp_extract(v1, {q('^((?:' + m.informal_any(m.LEVELS['4e'].agreement, False) + ')?)')}, 1)) + 1), v2], lambda x: x <> '')), lambda x: reverse(x)) end as ss from segd)"""
POOL = f"""ends as (select * from (values {END_VALUES}) e(ending, s1, s2, n)),
pool as (select token, left({low('token')}, length({low('token')}) - length(ending)) as stem, list_filter([s1, s2], lambda x: x <> '') as ss, 'verb_structured' as source, length({low('token')}) - length(ending) as ord
    from forms join ends on ends_with({low('token')}, ending) where length({low('token')}) - length(ending) >= 2
  union all select token, stem, ss, source, split + 100000 from segs where source = 'nominal' or length(stem) >= 3 union all select token, token, []::varchar[], 'full_token', 1000000 from forms),
fl as (select p.*, coalesce(l.tr_top, false) as top, coalesce(l.tr_all, false) as al, coalesce(l.en, false) as en, regexp_extract({low('stem')}, '([{F_}{B_}])[^{F_}{B_}]*$', 1) as a, regexp_extract({low('ss[1]')}, '^[^{F_}{B_}]*([{F_}{B_}])', 1) as b from pool p left join lex l on l.word = {low('stem')}),
sco as (select *, case when top then 1000 when al then 500 else 0 end + case when en and not al and not top then 400 else 0 end + case source when 'verb_structured' then 300 when 'verbal' then 200 when 'nominal' then len(ss) * 90 else 0 end
  + length(stem) * 10 - len(list_filter(ss, lambda x: length(x) = 1)) * 50 + case when coalesce(a, '') = '' or coalesce(b, '') = '' then 0 when contains('{F_}', a) = contains('{F_}', b) then 10 else -5 end as score from fl),
whole as (select token, score as wscore, top or al or en as known from sco where source = 'full_token'),
win as (select * from sco qualify row_number() over (partition by token order by score desc, length(stem) desc, ord) = 1),
res as (select *, lower(replace(stem || array_to_string(ss, ''), 'İ', 'i̇')) = {low('win.token')} and (len(ss) > 0 or top or al or en) as ok from win join whole using (token))"""


@query(
    "morph_parse",
    f"""with {sql_labels()}, {FORMS}, {WIDE}, {FIRST}, {POOL} select token, case when ok then stem else token end as root, case when ok then array_to_string(ss, '+') else '' end as segments,
  case when not ok then 'whole_token_fallback' when source = 'full_token' then 'full_lexical_item' else source end as source,
  case when not ok then 'invalid_parser_proposal' when len(ss) > 0 and (top or al or en) and known and score - wscore < 50 then 'ambiguous_candidate' when top or al then 'full_turkish_lexical_item' when en then 'english_root_turkish_suffix' when len(ss) > 0 then 'ambiguous_candidate' else 'invalid_parser_proposal' end as category from res""",
)
def morph_parse(spark: SparkSession, d: str) -> DataFrame:
    return ps.parse(forms(spark, d), lookups(spark, d)).select("token", "root", F.array_join("segments", "+").alias("segments"), "source", "category")


@query(
    "dictionary_lookup",
    """with t as (select distinct item as term from gold_rows where item is not null and regexp_full_match(item, '[A-Za-zçğıöşüÇĞÖŞÜ]+(?:[''’][a-zçğıöşü]+)?')), n as (select term, lower(translate(translate(term, '''’', ''), 'I', 'ı')) as query from t),
d as (select distinct lower(translate(translate(trim(word), '''’', ''), 'İI', 'iı')) as query from lexicon where lang = 'TR') select term, n.query, case when d.query is not null then 'FOUND' else 'NOT_FOUND' end as status from n left join d using (query)""",
)
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows").select(F.col("item").alias("term")).where(F.col("term").rlike("^[A-Za-zçğıöşüÇĞÖŞÜ]+(?:['’][a-zçğıöşü]+)?$")).distinct()
    words = table(spark, d, "lexicon").where("lang = 'TR'").select(F.col("word").alias("headword"), F.lit("[]").alias("body"))
    return dic.lookup(g, words).select("term", "query", "status")


@query("dictionary_lookup_all")
def dictionary_lookup_all(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct item, in the full normal form, which DuckDB can't follow; tested by brute force."""
    g = table(spark, d, "gold_rows").select(F.col("item").alias("term")).where("item is not null").distinct()
    words = table(spark, d, "lexicon").where("lang = 'TR'").select(F.col("word").alias("headword"), F.lit("[]").alias("body"))
    return dic.lookup(g, words).select("term", "query", "status")
