"""Queries of analysis, editing and export over the row model (token_rows) and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions import text as t
from kilim.operators import corpus as c
from kilim.operators import exports as x
from kilim.plans.annotation import low, q
from kilim.plans.registry import query
from kilim.sources.tables import table

ROWS = """rows as (select distinct on (row_id) row_id, dataset_id, bidx, ridx, token, label, gloss, reviewed from token_rows order by row_id, loaded_at desc)"""
WS = r"[\s\p{Z}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, {q('^' + WS + '+')}, ''), {q(WS + '+$')}, '')"


def sql_meta(e: str) -> str:
    s = sql_strip(e)
    return f"coalesce({s} = '' or {s} in ('MatrixLang', 'EmbedLang') or lower({s}) in ('sentenceid', 'sentid', 'sentence_id', 'sent_id'), false)"


def sql_fold(e: str) -> str:
    return f"translate(replace({low(e)}, 'ß', 'ss'), 'ς', 'σ')"


EDGE = r"[^\p{L}\p{N}]"


def sql_edges(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, {q('^' + EDGE + '+')}, ''), {q(EDGE + '+$')}, '')"


FREQ = f"nullif({sql_fold(sql_edges(sql_strip('token')))}, '')"
LAB = sql_strip("coalesce(label, '')")


def rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "token_rows").select("row_id", "dataset_id", "bidx", "ridx", "token", "label", "gloss", "reviewed", "loaded_at")
    return c.latest(r, "row_id").drop("loaded_at", "row_id")


@query(
    "word_frequency",
    f"""with {ROWS}, f as (select {FREQ} as token, {LAB} as label, count(*) as k from rows where not {sql_meta('token')} group by 1, 2)
select token, sum(k) as n, coalesce(string_agg(label || ':' || k, ', ' order by label || ':' || k) filter (where label <> ''), '') as breakdown from f where token is not null group by token""",
)
def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    return c.word_frequencies(rows(spark, d))


@query("word_frequency_by_label", f"with {ROWS} select {FREQ} as token, count(*) as n, 'MIXED:' || count(*) as breakdown from rows where not {sql_meta('token')} and {LAB} = 'MIXED' and {FREQ} is not null group by 1")
def word_frequency_by_label(spark: SparkSession, d: str) -> DataFrame:
    return c.word_frequencies(rows(spark, d), ("MIXED",))


@query("label_rows", f"with {ROWS} select dataset_id, bidx, ridx, token, label from rows where not {sql_meta('token')} and {LAB} in ('UID', 'LANG3')")
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    return c.label_rows(rows(spark, d), ("UID", "LANG3")).select("dataset_id", "bidx", "ridx", "token", "label")


@query("find_occurrences", f"with {ROWS} select dataset_id, bidx, ridx, token, label from rows where not {sql_meta('token')} and {sql_fold(sql_edges('token'))} = 'sonra'")
def find_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return c.occurrences(rows(spark, d), "SONRA.").select("dataset_id", "bidx", "ridx", "token", "label")


def sql_last(name: str, solid: bool = False) -> str:
    return f"arg_max({LAB}, ridx) filter (where {sql_strip('token')} = '{name}'{f' and {LAB} <> ' + chr(39) * 2 if solid else ''})"


SMETA = f"""smeta as (select dataset_id, bidx, coalesce({sql_last('SentenceID', True)}, (bidx + 1)::varchar) as sent_id, coalesce({sql_last('MatrixLang')}, '') as matrix_lang, coalesce({sql_last('EmbedLang')}, '') as embed_lang from rows group by 1, 2)"""


@query("sentence_meta", f"with {ROWS}, {SMETA} select * from smeta")
def sentence_meta(spark: SparkSession, d: str) -> DataFrame:
    return c.sentence_meta(rows(spark, d))


@query("mixed_rows", f"with {ROWS}, {SMETA} select dataset_id, bidx, ridx, sent_id, token, gloss from rows join smeta using (dataset_id, bidx) where upper({LAB}) = 'MIXED' and not {sql_meta('token')}")
def mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    return c.mixed_rows(rows(spark, d))


@query("grid_search", f"with {ROWS} select * from (select dataset_id, bidx, ridx, unnest([1, 2, 3]) as col, unnest([token, label, gloss]) as v from rows) where contains({low('v')}, 'loc') ".replace("select * from", "select dataset_id, bidx, ridx, col from"))
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    return c.grid_search(rows(spark, d), "LOC")


NUMBERED = f"numbered as (select *, case when not {sql_meta('token')} then count(*) filter (where not {sql_meta('token')}) over (partition by dataset_id order by bidx, ridx) end as idx from rows)"


@query("token_numbering", f"with {ROWS}, {NUMBERED} select dataset_id, bidx, ridx, idx, token from numbered")
def token_numbering(spark: SparkSession, d: str) -> DataFrame:
    return c.renumber(rows(spark, d)).select("dataset_id", "bidx", "ridx", "idx", "token")


@query(
    "grid_view",
    f"""with {ROWS}, seps as (select dataset_id, bidx, null::int as ridx, true as is_sep, null::varchar as token, null::varchar as label, null::varchar as gloss from rows group by 1, 2
  qualify bidx < max(bidx) over (partition by dataset_id)),
u as (select dataset_id, bidx, ridx, false as is_sep, token, label, gloss from rows union all select * from seps)
select dataset_id, row_number() over (partition by dataset_id order by bidx, is_sep, ridx) - 1 as vis_r, bidx, ridx, is_sep, token, label, gloss from u""",
)
def grid_view(spark: SparkSession, d: str) -> DataFrame:
    return c.grid_view(rows(spark, d))


def sql_kwic(rx: str, n: int) -> str:
    return f"""with d as (select doc_id, text, regexp_extract_all(text, {q(rx)}) as m, regexp_split_to_array(text, {q(rx)}) as r from documents where regexp_matches(text, {q(rx)})),
h as (select doc_id, text, unnest(m) as mm, unnest(list_transform(m, lambda v, i: (list_sum(list_transform(r[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::int)) as pos from d)
select doc_id, pos, trim(regexp_replace(text[greatest(pos - {n}, 0) + 1:pos], '\\s+', ' ', 'g')) as "left", trim(regexp_replace(mm, '\\s+', ' ', 'g')) as match, trim(regexp_replace(text[pos + length(mm) + 1:pos + length(mm) + {n}], '\\s+', ' ', 'g')) as "right"
from h where length(mm) > 0 order by doc_id, pos limit {c.KWIC_MOST}"""


@query("kwic_literal", sql_kwic(r"(?i)(geçen hafta)", 30))
def kwic_literal(spark: SparkSession, d: str) -> DataFrame:
    return c.kwic(table(spark, d, "documents"), "geçen hafta")


@query("kwic_regex", sql_kwic(r"([a-z]+'(?:de|da|den|dan))", 20))
def kwic_regex(spark: SparkSession, d: str) -> DataFrame:
    return c.kwic(table(spark, d, "documents"), "[a-z]+'(?:de|da|den|dan)", literal=False, ignore_case=False, context=20)


@query(
    "sentence_context",
    "with d as (select doc_id, text, instr(text, ' the ') - 1 as pos from documents where contains(text, ' the ')) select doc_id, trim(regexp_extract(text[1:pos], '([^.?!\n]*)$', 1) || ' the ' || regexp_extract(text[pos + 6:], '^([^.?!\n]*[.?!]?)', 1)) as sentence from d",
)
def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit(" the ")))
    return docs.select("doc_id", c.sentence_around(F.col("text"), F.instr("text", " the ") - 1, F.lit(5)).alias("sentence"))


ANY = f"({c.GLOSS_ANY})"
PICK = " ".join(f"when length(z) = {n} and regexp_matches(z, {q('^(?:' + c.backwards(s) + ')$')}) then {q(g)}" for n, s, g in c.GLOSSES)
GLOSS_SQL = f"""with {ROWS}, tk as (select distinct {sql_strip('token')} as token from rows where {LAB} = 'MIXED' and {sql_strip('token')} <> ''),
cut as (select token, case when contains(token, '-') then '-' when contains(token, '''') then '''' end as mark from tk),
prt as (select token, case when mark is null then token else string_split(token, mark)[-1] end as suf, mark from cut),
hd as (select *, case when mark is null then '' else token[1:length(token) - length(suf) - 1] end as stem, {sql_fold('suf')} as low from prt),
rn as (select *, regexp_extract(reverse(low), {q('^((?:' + c.GLOSS_ANY + '){0,12})')}, 1) as run from hd),
gl as (select *, list_reverse(list_transform(regexp_extract_all(run, {q(ANY)}), lambda z: case {PICK} end)) as chain from rn)
select token, case when run = '' then '' else coalesce(nullif(trim(stem), ''), nullif(trim(suf[1:length(low) - length(run)]), ''), token) || '-' || array_to_string(list_transform(chain, lambda z: string_split(z, '|')[1]), '-') end as gloss from gl"""


@query("auto_gloss", GLOSS_SQL)
def auto_gloss(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d).where((t.strip(F.col("label")) == "MIXED") & (t.strip(F.col("token")) != "")).select(t.strip(F.col("token")).alias("token")).distinct()
    return r.select("token", F.coalesce(F.get(c.auto_gloss(F.col("token")), F.lit(0)), F.lit("")).alias("gloss"))


@query(
    "merge_adjacent",
    f"""with {ROWS}, run as (select dataset_id, bidx, min(ridx) as a from rows where not {sql_meta('token')} group by 1, 2 having count(*) >= 2),
j as (select r.*, run.a, run.a is not null and ridx between run.a and run.a + 1 as inside from rows r left join run using (dataset_id, bidx))
select dataset_id, bidx, ridx, token, label, gloss from j where not inside
union all select dataset_id, bidx, a, string_agg(token, '' order by ridx), 'MIXED', '' from j where inside group by dataset_id, bidx, a""",
)
def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    runs = r.where(~t.is_meta(F.col("token"))).groupBy("dataset_id", "bidx").agg(F.min("ridx").alias("first"), F.count("*").alias("n")).where("n >= 2")
    runs = runs.select("dataset_id", "bidx", "first", (F.col("first") + 1).alias("last"), F.lit("MIXED").alias("label"), F.lit("").alias("gloss"))
    return c.merge_runs(r, runs)


EDITED = f"""edited as (select dataset_id, bidx, ridx, token, case when {LAB} = 'UID' then 'EN' when {sql_strip('token')} = 'MatrixLang' then label else label end as label, gloss,
  ({LAB} = 'UID' and not {sql_meta('token')}) or coalesce(reviewed, false) as reviewed, {LAB} = 'UID' as hit from rows)"""


@query("edit_apply", f"with {ROWS}, {EDITED} select dataset_id, bidx, ridx, token, label, gloss, reviewed from edited")
def edit_apply(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    edits = r.where(t.strip(F.col("label")) == "UID").select("dataset_id", "bidx", "ridx", F.lit("EN").alias("label"), F.lit(None).cast("string").alias("gloss"))
    return c.relabel(r, edits)


@query(
    "review_apply",
    f"""with {ROWS}, {EDITED}, v as (select dataset_id, bidx, count(*) filter (where label = 'TR' and not {sql_meta('token')}) as tr, count(*) filter (where label = 'EN' and not {sql_meta('token')}) as en, count(*) filter (where label = 'MIXED' and not {sql_meta('token')}) as mx, bool_or(hit) as changed from edited group by 1, 2)
select dataset_id, bidx, ridx, token, gloss, reviewed, case when not changed then label
  when {sql_strip('token')} = 'MatrixLang' then case when tr + 0.6::double * mx >= en + 0.4::double * mx then 'TR' else 'EN' end
  when {sql_strip('token')} = 'EmbedLang' then case when tr + 0.6::double * mx >= en + 0.4::double * mx then case when en + mx > 0 then 'EN' else '-' end else case when tr + mx > 0 then 'TR' else '-' end end
  else label end as label from edited join v using (dataset_id, bidx)""",
)
def review_apply(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    edits = r.where(t.strip(F.col("label")) == "UID").select("dataset_id", "bidx", "ridx", F.lit("EN").alias("label"), F.lit(None).cast("string").alias("gloss"))
    return c.revote(c.relabel(r, edits), edits)


@query(
    "delete_rows",
    f"""with {ROWS}, kept as (select * from rows where coalesce({LAB}, '') <> 'OTHER')
select dataset_id, dense_rank() over (partition by dataset_id order by bidx) - 1 as bidx, row_number() over (partition by dataset_id, bidx order by ridx) - 1 as ridx, token, label from kept""",
)
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return c.delete_rows(r, r.where(t.strip(F.col("label")) == "OTHER")).select("dataset_id", "bidx", "ridx", "token", "label")


@query(
    "insert_rows",
    f"""with {ROWS}, u as (select dataset_id, bidx, ridx::double as o, token, label from rows union all select dataset_id, bidx, ridx - 0.5, '', '' from rows where {LAB} = 'MIXED')
select dataset_id, bidx, row_number() over (partition by dataset_id, bidx order by o) - 1 as ridx, token, label from u""",
)
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return c.insert_before(r, r.where(t.strip(F.col("label")) == "MIXED")).select("dataset_id", "bidx", "ridx", "token", "label")


@query("next_dataset_name", r"select 'Data ' || (coalesce(max(try_cast(regexp_extract(name, '^\s*Data (\d{1,9})\s*$', 1) as bigint)), 0) + 1) as next_name from datasets")
def next_dataset_name(spark: SparkSession, d: str) -> DataFrame:
    return c.next_name(table(spark, d, "datasets"))


def sql_line(fields: list[str]) -> str:
    return "regexp_replace(" + " || '\t' || ".join(f"coalesce({f}, '')" for f in fields) + ", '(?:\t[\\s]*)+$', '')"


BLOCKS = f"""lines as (select dataset_id, bidx, ridx, case when idx is null then {sql_line(['token', 'label', 'gloss'])} else {sql_line(['idx::varchar', 'token', 'label', 'gloss'])} end as line from numbered where coalesce(token, '') <> ''),
blocks as (select dataset_id, bidx, string_agg(line, '\n' order by ridx) as text from lines group by 1, 2)"""


@query("export_txt", f"with {ROWS}, {NUMBERED}, {BLOCKS} select dataset_id, string_agg(text, '\n\n' order by bidx) as text from blocks group by 1")
def export_txt(spark: SparkSession, d: str) -> DataFrame:
    return x.dataset_texts(rows(spark, d))


LEX_ROWS = f"lexrows as (select *, row_number() over (partition by dataset_id, bidx order by ridx) as i from rows where not {sql_meta('token')})"


def sql_field(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '[\t\r\n]', ' ', 'g')"


CONLL = f"""body as (select dataset_id, bidx, string_agg(i || '\t' || {sql_field('token')} || '\t' || {sql_field('label')} || '\t' || coalesce(nullif({sql_field(sql_strip('gloss'))}, ''), '_'), '\n' order by i) as body from lexrows group by 1, 2),
chunks as (select dataset_id, bidx, concat_ws('\n', '# sent_id = ' || {sql_field('sent_id')}, case when matrix_lang <> '' then '# matrix_lang = ' || matrix_lang end, case when embed_lang <> '' then '# embedded_lang = ' || embed_lang end, body) as chunk from smeta left join body using (dataset_id, bidx))"""


@query("export_conll", f"with {ROWS}, {SMETA}, {LEX_ROWS}, {CONLL} select dataset_id, '# CoNLL export\n# columns = TokenIndex Token Label Gloss\n\n' || string_agg(chunk, '\n\n' order by bidx) || '\n' as text from chunks group by 1")
def export_conll(spark: SparkSession, d: str) -> DataFrame:
    return x.conll_texts(rows(spark, d))


@query(
    "export_jsonl",
    f"""with {ROWS}, {SMETA}, {LEX_ROWS}, tk as (select dataset_id, bidx, string_agg(coalesce(token, ''), ' ' order by i) as source_text, string_agg(i || '/' || coalesce(token, '') || '/' || coalesce(label, '') || '/' || coalesce(gloss, ''), ' ' order by i) as tokens, count(*) as n from lexrows group by 1, 2)
select dataset_id, bidx, sent_id as sentence_id, coalesce(source_text, '') as source_text, matrix_lang, embed_lang as embedded_lang, coalesce(n, 0) as n, coalesce(tokens, '') as tokens from smeta left join tk using (dataset_id, bidx)""",
)
def export_jsonl(spark: SparkSession, d: str) -> DataFrame:
    r = x.sentence_records(rows(spark, d))
    flat = F.array_join(F.transform("tokens", lambda k: F.concat_ws("/", k["index"].cast("string"), k["token"], k["label"], k["gloss"])), " ")
    return r.select("dataset_id", "bidx", "sentence_id", "source_text", "matrix_lang", "embedded_lang", F.size("tokens").alias("n"), flat.alias("tokens"))


@query("round_trip", f"""with {ROWS}, r as (select dataset_id, bidx, ridx, {sql_strip('token')} as token, {LAB} as label, gloss from rows where {sql_strip("coalesce(token, '')")} <> ''), b as (select *, dense_rank() over (partition by dataset_id order by bidx) - 1 as nb from r)
select dataset_id, nb as bidx, row_number() over (partition by dataset_id, bidx order by ridx) - 1 as ridx, token, label from b""")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Export and parse again: tokens and labels come back, glosses don't."""
    return x.parse_annotated(x.dataset_texts(rows(spark, d)))
