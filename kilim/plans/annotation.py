"""Queries of the annotation cascade over documents: tokens, labels, votes, entities, suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions import morphology as m
from kilim.functions import text as t
from kilim.operators import labeling as lab
from kilim.plans.registry import query
from kilim.session import spread
from kilim.sources.tables import table


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def low(x: str) -> str:
    """Lower case as Spark has it: the dotted capital I becomes i and a combining dot."""
    return f"lower(replace({x}, 'İ', 'i̇'))"


def sql_any(x: str, values: list[str]) -> str:
    return f"{x} in ({', '.join(map(q, values))})"


def sql_shape(x: str) -> str:
    r = lambda p: f"regexp_matches({x}, {q(p)})"
    return f"""case when {x} = '' then 'empty' when {r(t.URL)} then 'url' when {r(t.MENTION)} then 'mention' when {r(t.HASHTAG)} then 'hashtag'
      when {r(t.NUMBER)} then 'number' when {r(t.CODE)} and {r('[A-Za-z]')} and {r('[0-9]')} then 'code' when {r(t.ASTRAL)} then 'emoji' when {r(t.SIGNS)} then 'signs' end"""


def sql_clean(x: str) -> str:
    return f"regexp_replace({x}, {q(chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(39) + '’' + chr(93) + '+')}, '', 'g')"


def sql_nominal_analysis(x: str) -> str:
    return "(" + " or ".join(f"({sql_any(f'right({low(x)}, {n})', [s for s in m.FULL if len(s) == n])} and length({low(x)}) > {n + 1})" for n in (4, 3, 2)) + ")"


SENTS = f"""sents as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as sent_no from (
  select doc_id, list_filter(regexp_split_to_array(text, {q(t.LINE)}), lambda x: regexp_matches(x, {q(t.SOLID)})) as ls from documents where text is not null))"""
TOKS = f"""{SENTS}, toks as (select doc_id, sent_no, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as pos from (
  select doc_id, sent_no, regexp_extract_all(line, {q(t.TOKEN)}) as ts from sents))"""
LEX = f"""lex as (select word, bool_or(lang = 'TR' and coalesce(word_rank < {lab.TOP_RANK}, false)) as tr_top, bool_or(lang = 'TR') as tr_all, bool_or(lang = 'EN') as en from (
  select {low("string_split_regex(trim(word), '\\s+')[1]")} as word, upper(lang) as lang, word_rank from lexicon) where word <> '' group by word)"""


def sql_base(n: int) -> str:
    base = low(sql_clean(f"left(token, greatest(length(token) - {n}, 0))"))
    return f"""case when {sql_any(f'right({low("token")}, {n})', [s for s in m.CLOSED if len(s) == n])} and length({base}) >= 2
      and (substr({low("token")}, length({low("token")}) - {n - 1}, 1) not in ('y', 'n') or {sql_any(f'right({base}, 1)', list(lab.VOWELS))}) then {base} end as b{n}"""


def sql_choice(a: str) -> str:
    return f"case when coalesce({a}.tr_top, false) then 'TR' when coalesce({a}.en, false) then 'EN' when coalesce({a}.tr_all, false) then 'TR' else 'UID' end"


def sql_labels(named: str = "false", extra: str = "") -> str:
    """CTEs that end in labs(doc_id, sent_no, pos, token, shape, label)."""
    contraction = sql_any(low("apo[2]"), ["s", "re", "ve", "m", "ll", "d", "t"])
    return f"""{TOKS}, {LEX}{extra}, keyed as (select *, {sql_shape('token')} as shape, {low(sql_clean('token'))} as k0, {low('token')} as k1,
  case when len(apo) = 2 and apo[1] <> '' and apo[2] <> '' and not {contraction} then {low(sql_clean('apo[1]'))} end as kb,
  {sql_base(4)}, {sql_base(3)}, {sql_base(2)} from (select *, regexp_split_to_array(token, '[''’]') as apo from toks)),
labs as (select k.doc_id, k.sent_no, k.pos, k.token, k.shape, case when k.shape is not null then 'OTHER' when {named} then 'NE'
  when k.kb is not null and {sql_choice('b')} = 'EN' then 'MIXED' when k.kb is not null and {sql_choice('b')} = 'TR' then 'TR'
  when {sql_choice('a')} <> 'TR' and not coalesce(w.tr_all, false) and ((coalesce(c4.en, false) and not c4.tr_all) or (coalesce(c3.en, false) and not c3.tr_all) or (coalesce(c2.en, false) and not c2.tr_all)) then 'MIXED'
  else {sql_choice('a')} end as label
  from keyed k left join lex a on a.word = k.k0 left join lex w on w.word = k.k1 left join lex b on b.word = k.kb
  left join lex c4 on c4.word = k.b4 left join lex c3 on c3.word = k.b3 left join lex c2 on c2.word = k.b2{' left join ents e on e.doc_id = k.doc_id and e.sent_no = k.sent_no and e.token = k.token' if extra else ''})"""


VOTES = """votes as (select s.doc_id, s.sent_no, count(l.token) as n_tokens, case when tr + 0.6::double * mx >= en + 0.4::double * mx then 'TR' else 'EN' end as matrix_lang,
  case when tr + 0.6::double * mx >= en + 0.4::double * mx then case when en + mx > 0 then 'EN' else '-' end else case when tr + mx > 0 then 'TR' else '-' end end as embed_lang
  from (select s.doc_id, s.sent_no, count(*) filter (where label = 'TR') as tr, count(*) filter (where label = 'EN') as en, count(*) filter (where label = 'MIXED') as mx
        from sents s left join labs l using (doc_id, sent_no) group by all) s left join labs l using (doc_id, sent_no) group by s.doc_id, s.sent_no, tr, en, mx)"""


def lookups(spark: SparkSession, d: str) -> lab.Lookups:
    return lab.Lookups(lab.lexicon(table(spark, d, "lexicon")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return t.tokens(t.sentences(corpus(spark, d)))


@query("tokenize_documents", f"with {TOKS} select doc_id, count(*) as n_tokens, count(distinct sent_no) as n_lines, count({sql_shape('token')}) as n_other, sum(length(token)) as n_letters from toks group by doc_id")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    tok = corpus_tokens(spark, d)
    return tok.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("sent_no").alias("_"), F.count_distinct("sent_no").alias("n_lines"), F.count(t.shape(F.col("token"))).alias("n_other"), F.sum(F.length("token")).alias("n_letters")).drop("_")


@query("token_shape_census", f"with {TOKS} select coalesce({sql_shape('token')}, 'word') as shape, count(*) as n, count(distinct token) as n_forms from toks group by 1")
def token_shape_census(spark: SparkSession, d: str) -> DataFrame:
    forms = corpus_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    return forms.groupBy(F.coalesce(t.shape(F.col("token")), F.lit("word")).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query("lexicon_flags", f"with {LEX} select * from lex")
def lexicon_flags(spark: SparkSession, d: str) -> DataFrame:
    return lab.lexicon(table(spark, d, "lexicon"))


@query("lexicon_build", f"""with {TOKS}, f as (select {low('token')} as word, count(*) as n from toks where {sql_shape('token')} is null group by 1)
select word, n, row_number() over (order by n desc, word) as word_rank from f where length(word) >= 2 qualify word_rank <= 2000""")
def lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    """A top-2000 frequency lexicon; the rank is taken over the 2000 rows that are left."""
    from pyspark.sql import Window

    tok = corpus_tokens(spark, d).where(t.shape(F.col("token")).isNull())
    f = tok.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).where(F.length("word") >= 2)
    top = f.orderBy(F.desc("n"), "word").limit(2000)
    return top.select("word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("word_rank"))


@query("label_tokens", f"with {sql_labels()} select doc_id, sent_no, pos, token, shape, label from labs")
def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    return lab.label(corpus_tokens(spark, d), lookups(spark, d)).select("doc_id", "sent_no", "pos", "token", "shape", "label")


@query("label_census_by_lang", f"with {sql_labels()} select coalesce(d.lang, '') as lang, label, count(*) as n from labs join documents d using (doc_id) group by 1, 2")
def label_census_by_lang(spark: SparkSession, d: str) -> DataFrame:
    tok = lab.label(corpus_tokens(spark, d), lookups(spark, d))
    per_doc = tok.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    lang = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return per_doc.join(lang, "doc_id").groupBy("lang", "label").agg(F.sum("n").alias("n"))


@query("sentence_votes", f"with {sql_labels()}, {VOTES} select * from votes")
def sentence_votes(spark: SparkSession, d: str) -> DataFrame:
    return lab.annotate(corpus(spark, d), lookups(spark, d))[1]


@query("sentence_matrix_embed", f"with {sql_labels()}, {VOTES} select matrix_lang, embed_lang, count(*) as n_sentences, sum(n_tokens) as n_tokens from votes group by 1, 2")
def sentence_matrix_embed(spark: SparkSession, d: str) -> DataFrame:
    v = lab.annotate(corpus(spark, d), lookups(spark, d))[1]
    return v.groupBy("matrix_lang", "embed_lang").agg(F.count("*").alias("n_sentences"), F.sum("n_tokens").alias("n_tokens"))


@query(
    "annotated_rows",
    f"""with {sql_labels()}, {VOTES} select doc_id, sent_no, -1 as o, 'SentenceID' as token, sent_no::varchar as label from votes
union all select doc_id, sent_no, pos, token, label from labs union all select doc_id, sent_no, {2**30}, 'MatrixLang', matrix_lang from votes
union all select doc_id, sent_no, {2**30 + 1}, 'EmbedLang', embed_lang from votes""",
)
def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    return lab.annotated_rows(*lab.annotate(corpus(spark, d), lookups(spark, d)))


# Entities by a rule, as no recogniser is at hand: a capitalised token inside a line begins an
# entity that takes in the token behind it; its type follows from the token's length.
ENTS = r"""caps as (select *, lead(token) over (partition by doc_id, sent_no order by pos) as behind from toks),
raw as (select doc_id, sent_no, token || coalesce(' ' || behind, '') as text, case length(token) % 4 when 0 then 'PERSON' when 1 then 'LOCATION' when 2 then 'ORGANIZATION' else 'TIME' end as type
  from caps where pos > 0 and regexp_matches(token, '^\p{Lu}')),
pieces as (select doc_id, sent_no, type, p, i, n, len(list_filter(us, lambda u: u)) - us[i]::int as others from (
  select *, unnest(ps) as p, generate_subscripts(ps, 1) as i, len(ps) as n, list_transform(ps, lambda x: regexp_matches(x, '^\p{Lu}\p{L}*$')) as us from (
    select *, regexp_extract_all(text, '[\p{L}\p{N}_]+[''’]?[\p{L}\p{N}_]*|[\p{L}\p{N}_]+') as ps from raw))),
ents as (select doc_id, sent_no, p as token, bool_or(type <> 'TIME') as named, bool_or(type in ('PERSON', 'LOCATION') or (type = 'ORGANIZATION' and n > 1 and others > 0)) as guarded from pieces group by all)"""
GIVES_WAY = rf"""(not regexp_matches(k.token, '[''’]') and coalesce(a.en, false) and not coalesce(a.tr_all, false) and k.token <> 'REDACTED'
  and not (regexp_matches(k.token, '\p{{Lu}}') and not regexp_matches(k.token, '\p{{Ll}}') and length(k.token) > 1) and not regexp_matches(k.token, '\p{{Nd}}') and not {sql_nominal_analysis('k.token')})"""


def rule_entities(tok: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    behind = F.lead("token").over(Window.partitionBy("doc_id", "sent_no").orderBy("pos"))
    kind = F.get(F.array(*map(F.lit, ("PERSON", "LOCATION", "ORGANIZATION", "TIME"))), F.length("token") % 4)
    e = tok.withColumn("behind", behind).where((F.col("pos") > 0) & F.col("token").rlike(r"^\p{Lu}"))
    return e.select("doc_id", "sent_no", F.concat("token", F.coalesce(F.concat(F.lit(" "), "behind"), F.lit(""))).alias("text"), kind.alias("type"))


@query("ne_arbitration", f"with {sql_labels(f'coalesce(e.named and (e.guarded or not {GIVES_WAY}), false)', ', ' + ENTS)} select doc_id, sent_no, pos, token, label from labs")
def ne_arbitration(spark: SparkSession, d: str) -> DataFrame:
    tok = corpus_tokens(spark, d)
    return lab.label(tok, lookups(spark, d), rule_entities(tok)).select("doc_id", "sent_no", "pos", "token", "label")


def sql_cut(g: str, stage: str) -> str:
    return f"regexp_extract_all({g}, {q(stage)})"


def sql_map(table_: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{q(s[::-1])}: {q(v)}" for s, v in table_.items()) + "}"


NOMINAL = f"""words as (select distinct {low('token')} as word from toks where {sql_shape('token')} is null),
parts as (select word, {", ".join(f"regexp_extract(reverse(word), {q(m.NOMINAL)}, {i}) as g{i}" for i in range(1, 6))} from words),
cuts as (select *, {sql_cut('g1', m.STAGE_CASE)} as c, {sql_cut('g2', m.STAGE_POSSESSIVE)} as p, {sql_cut('g4', m.STAGE_DERIVATION)} as v from parts),
tagged as (select word, array_to_string(list_transform(list_reverse(list_filter(c || p || [g3] || v || [g5], lambda x: x <> '')), lambda x: reverse(x)), '+') as segments,
  array_to_string(list_sort(list_distinct(list_filter(string_split(array_to_string(list_transform(c, lambda x: {sql_map({**m.CASE, **m.BUFFER_N})}[x]) || list_transform(p, lambda x: coalesce({sql_map(m.POSSESSIVE)}[x], '')) || [case when g3 <> '' then 'Number=Plur' else '' end], '|'), '|'), lambda x: x <> ''))), '|') as ud,
  array_to_string(list_sort(list_distinct(list_filter(string_split(array_to_string(list_transform(v, lambda x: {sql_map(m.DERIVATION)}[x]) || [case when g5 <> '' then 'Unparsed=Leftover' else '' end], '|'), '|'), lambda x: x <> ''))), '|') as deriv,
  len(list_filter(p, lambda x: x in ('ı', 'i', 'u', 'ü'))) > 0 as ambiguous, {sql_nominal_analysis('word')} as has_analysis from cuts)"""


@query("nominal_suffix_parse", f"with {TOKS}, {NOMINAL} select * from tagged")
def nominal_suffix_parse(spark: SparkSession, d: str) -> DataFrame:
    w = corpus_tokens(spark, d).where(t.shape(F.col("token")).isNull()).select(F.lower("token").alias("word")).distinct()
    n = w.withColumn("n", m.nominal(F.col("word")))
    return n.select("word", F.array_join("n.segments", "+").alias("segments"), F.array_join("n.ud", "|").alias("ud"), F.array_join("n.deriv", "|").alias("deriv"), (F.size("n.amb") > 0).alias("ambiguous"), m.has_nominal_analysis(F.col("word")).alias("has_analysis"))
