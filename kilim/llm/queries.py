"""Queries pN_... of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.llm import bpe, garble, language, leakage, lookalike, overlap, personal, quality, splits
from kilim.session import cut, shared_dir
from kilim.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p10_profiles(spark: SparkSession, d: str) -> quality.Profiles:
    return quality.profiles_of(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p10_stats")
def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), p10_profiles(spark, d))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    s = quality.statistics(table(spark, d, "documents"), p10_profiles(spark, d))
    return s.where("kind is not null and kind <> 'prose'").select("doc_id", "kind").distinct()


def texts(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """(table_name, rec_id, text) of the given tables, repeated rows once."""
    column = {"datasets": ("dataset_id", "source_text"), "gold_rows": ("row_id", "item"), "token_rows": ("row_id", "token"), "documents": ("doc_id", "text")}
    out = None
    for n in names:
        rec, text = column[n]
        part = table(spark, d, n).select(F.lit(n).alias("table_name"), F.col(rec).alias("rec_id"), F.col(text).alias("text")).where("text is not null")
        out = part if out is None else out.unionByName(part)
    return out


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.findings(texts(spark, d, "datasets", "gold_rows"), ("gold_rows",)).select("table_name", "rec_id").distinct()


@query("p4_restored")
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d, "datasets", "gold_rows")
    return garble.restored_texts(t, garble.findings(t, ("gold_rows",)))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(texts(spark, d, "gold_rows", "token_rows")).select("table_name", "rec_id").distinct()


@query("p5_forms")
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(texts(spark, d, "gold_rows", "token_rows"))


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(texts(spark, d, "datasets", "gold_rows"), table(spark, d, "given_names"), ("gold_rows",))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_spans(spark, d).select("table_name", "rec_id", F.col("type").alias("pii_type")).distinct()


@query("p3_redacted")
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(texts(spark, d, "datasets", "gold_rows"), p3_spans(spark, d))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "block_records").select(F.col("block_index").alias("key"), "split", "text").where("text is not null")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlap.record_pairs(blocks(spark, d))
    return p.where("eval_key <> train_key").select(F.least("eval_key", "train_key").alias("block_index_a"), F.greatest("eval_key", "train_key").alias("block_index_b")).distinct()


@query("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source: evaluation blocks, and how many of them also stand in training."""
    hit = overlap.overlapped(blocks(spark, d)).select(F.col("key").alias("block_index"), "containment")
    b = table(spark, d, "block_records").where("split in ('dev', 'test')").select("split", "source_id", "block_index").distinct()
    return b.join(hit, "block_index", "left").groupBy("split", "source_id").agg(F.count("*").alias("n_blocks"), F.count("containment").alias("n_overlapping"), F.avg("containment").alias("mean_containment"))


def block_components(spark: SparkSession, d: str) -> DataFrame:
    return splits.components(splits.edges(table(spark, d, "gold_rows"), "block_index", ("author_id", "source_id", "entity_key")))


def delivered_splits(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col("block_index").alias("record"), "split") for t in ("block_records", "scoreable_rows")]
    return parts[0].unionByName(parts[1])


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = splits.conflicts(block_components(spark, d), delivered_splits(spark, d))
    return c.select(F.col("component").alias("group_block_index"), F.col("record").alias("block_index"))


@query("p2_split")
def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """A new split per block, from nothing."""
    return splits.assign(block_components(spark, d)).select(F.col("record").alias("block_index"), F.col("component").alias("group_block_index"), "split")


@query("p2_kept")
def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """The delivered splits as the existing ones: kept, quarantined in conflict, filled up."""
    s = splits.assign(block_components(spark, d), previous=delivered_splits(spark, d))
    return s.select(F.col("record").alias("block_index"), F.col("component").alias("group_block_index"), "split")


@query("p2_incremental")
def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Components and splits of all blocks, kept in a persisted state that the rows reach in two
    halves (by block); the components are those of one run."""
    edge = cut(splits.edges(table(spark, d, "gold_rows"), "block_index", ("author_id", "source_id", "entity_key")))
    path = f"{shared_dir(spark)}/p2-state-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("record"), F.lit(2))
    splits.update_state(spark, path, edge.where(half == 0))
    s = cut(splits.update_state(spark, path, edge.where(half == 1)))
    splits.drop_state(spark, path)
    return s.select(F.col("record").alias("block_index"), F.col("component").alias("group_block_index"), "split")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query("p9_passages")
def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang")
    model = language.sentence_model(docs, table(spark, d, "eval_items"))
    return language.document_languages(docs, model, p10_profiles(spark, d))


def labelled_words(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, form, label) of the token rows of gold_rows."""
    g = table(spark, d, "gold_rows").where("trim(token) <> '' and trim(item) <> '' and item <> 'REDACTED'")
    return g.select(F.col("row_id").alias("rec_id"), language.folded(F.col("item")).alias("form"), "label")


def wrong_words(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, rec_id, lang, confidence) of plain words whose label is missing or wrong."""
    gold = labelled_words(spark, d)
    forms, _ = language.plain_forms(gold.select("form", "label"), table(spark, d, "lexicon"))
    score = table(spark, d, "scoreable_rows").where("trim(text) <> '' and text <> 'REDACTED'").select(F.col("gold_token_id").alias("rec_id"), language.folded(F.col("text")).alias("form"), F.col("ft_lang").alias("label"))
    rows = gold.select(F.lit("gold_rows").alias("table_name"), "*").unionByName(score.select(F.lit("scoreable_rows").alias("table_name"), "*"))
    rows = rows.withColumn("said", F.lower(F.trim("label")))
    # what a name, mixed or unknown word is called is not put in doubt by the word's look alone
    named = F.coalesce(F.col("said").isin("ne", "mixed", "uid", "other"), F.lit(False))
    j = rows.where(F.col("form").rlike(language.PLAIN)).join(forms, "form").where("said is null or said <> lang").where(~named | F.col("borne"))
    return j.select("table_name", "rec_id", "lang", "confidence").distinct()


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = language.wrong_documents(judged_documents(spark, d)).select(F.lit("documents").alias("table_name"), F.col("key").alias("rec_id"), "lang")
    return docs.unionByName(wrong_words(spark, d).select("table_name", "rec_id", "lang")).distinct()


@query("p6_documents")
def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and mixed segments of every document."""
    return judged_documents(spark, d).select(F.col("key").alias("doc_id"), "lang", "confidence", "segments")


@query("p6_words")
def p6_words(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every plain word form."""
    forms, _ = language.plain_forms(labelled_words(spark, d).select("form", "label"), table(spark, d, "lexicon"))
    return forms.select("form", "lang", "confidence")
