"""Readers of the files the annotation tools use; every reader is lazy and splittable where the
format allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions.text import strip

GOLD_HEADER = ("Token", "Item", "Label", "Gloss")


def utf8_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; a file that isn't valid UTF-8 raises when it is read."""
    b = spark.read.format("binaryFile").load(path)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return b.select("path", F.when(ok, F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).alias("text"))


def word_list(spark: SparkSession, path: str, lang: str, missing_ok: bool = False) -> DataFrame:
    """(word, lang, word_rank) of a list with one word a line: first field, lower case; the rank
    is the line's index in its file, blank lines counted. missing_ok: no file, no rows."""
    empty = spark.createDataFrame([], "word string, lang string, word_rank int")
    if missing_ok:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return empty
    t = spark.read.text(path, wholetext=True)
    lines = t.select(F.posexplode(F.split("value", "\n")).alias("i", "line"))
    w = lines.select(F.lower(F.get(F.split(strip(F.col("line")), r"\s+"), F.lit(0))).alias("word"), F.lit(lang).alias("lang"), F.col("i").cast("int").alias("word_rank"))
    return w.where("word <> ''").groupBy("word", "lang").agg(F.min("word_rank").alias("word_rank"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, token, item, label, gloss) of a gold CSV file; a header other than
    Token,Item,Label,Gloss raises."""
    raw = spark.read.text(path, wholetext=True).select(F.split_part("value", F.lit("\n"), F.lit(1)).alias("h"))
    for r in raw.limit(10_000).collect():
        if tuple(r.h.lstrip("﻿").rstrip("\r").split(",")) != GOLD_HEADER:
            raise ValueError(f"header is {r.h!r}, not {','.join(GOLD_HEADER)}")
    schema = ", ".join(f"{c.lower()} string" for c in GOLD_HEADER)
    d = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True, emptyValue="", nullValue="\0")
    return d.select((F.monotonically_increasing_id() + 1).alias("line_no"), *[F.coalesce(c.lower(), F.lit("")).alias(c.lower()) for c in GOLD_HEADER])


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, item, reason); a blank id only informs and is null."""
    d = spark.read.csv(path, header=True, schema="token_id string, item string, reason string")
    return d.withColumn("token_id", F.nullif(F.trim("token_id"), F.lit("")))


def mismatches(spark: SparkSession, path: str) -> DataFrame:
    """(block_index from 1, gold_parent_token_id, gold_echo_token_id), blank ids null."""
    d = spark.read.csv(path, header=True, schema="block_index int, gold_parent_token_id string, gold_echo_token_id string")
    return d.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("gold_parent_token_id", "gold_echo_token_id")})


def split_rows(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split of a JSON-lines data set; the filter reaches the reader."""
    return spark.read.json(path).where(F.col("split") == split)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of input files, for a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
