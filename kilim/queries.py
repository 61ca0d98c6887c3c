"""Queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilim.operators import gold_grammar as gg
from kilim.plans import annotation, corpus, evaluation, lexical, rerank, stream  # noqa: F401
from kilim.plans.registry import QUERIES, SQL, query  # noqa: F401
from kilim.sources.tables import table

# The grammar of one record as patterns; FIELD is a quoted or a plain field.
FIELD = """(?:"(?:[^"]|"")*"|[^",]*)"""
P7_SQL = rf"""
with l as (select distinct line_id, regexp_replace(raw_line, '\r$', '') as r from gold_lines),
c as (select line_id, case
  when r is null then 'COLUMNS'
  when not regexp_full_match(r, '{FIELD}(?:,{FIELD})*', 's') then 'QUOTING'
  when not regexp_full_match(r, '{FIELD}(?:,{FIELD}){{3}}', 's') then 'COLUMNS'
  when regexp_matches(r, '[\x00-\x09\x0b-\x1f\x7f-\x{{9f}}]') then 'VALUE'
  when regexp_full_match(r, '(?:[0-9]*[1-9][0-9]*|"[0-9]*[1-9][0-9]*"),(?:[^",]*[^",\s][^",]*|"(?:[^"]|"")*(?:[^"\s]|"")(?:[^"]|"")*"),"?(?:TR|EN|MIXED|UID|NE|LANG3|OTHER)"?,{FIELD}', 's') then null
  when regexp_full_match(r, '(?:"\s*"|\s*),(?:"?SentenceID"?,"?[0-9]*[1-9][0-9]*"?|"?MatrixLang"?,"?(?:TR|EN)"?|"?EmbedLang"?,"?(?:TR|EN|-)"?),{FIELD}', 's') then null
  when regexp_full_match(r, '(?:"\s*"|\s*)(?:,(?:"\s*"|\s*)){{3}}', 's') then null
  else 'VALUE' end as reason from l)
select distinct line_id, reason from c where reason is not null"""


@query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return gg.bad_lines(table(spark, d, "gold_lines"))


@query("p7_loaded")
def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    return gg.good_lines(table(spark, d, "gold_lines"), long_tokens=True)


@query("p7_errors")
def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    return gg.located_errors(table(spark, d, "gold_lines"))


@query("p7_files")
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the whole files, with recovery after broken quotes."""
    return gg.parse_delivered_files(table(spark, d, "gold_lines"))
