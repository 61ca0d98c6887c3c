"""Project files: versioned JSON documents of data sets, read strictly, written as version 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions.text import basename, strip

ROW = "struct<idx:string,token:string,label:string,gloss:string>"
BLOCKS = f"array<array<{ROW}>>"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null where the path is missing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def problem(v: Column) -> Column:
    """Why a payload can't be read, null if it can."""
    version = at(v, "$.version")
    n = F.when(version.isNull(), 1).otherwise(F.try_variant_get(v, "$.version", "int"))
    ds = at(v, "$.datasets")
    return (
        F.when(v.isNull(), "not JSON").when(~kind(v).startswith("OBJECT"), "not an object")
        .when(version.isNotNull() & (kind(version) != "BIGINT"), "invalid version").when(~n.isin(1, 2), "unsupported version")
        .when((n == 1) & ds.isNotNull(), "version 1 with datasets").when((n == 2) & ds.isNull(), "datasets missing")
        .when((n == 2) & ((kind(ds) != "ARRAY") | (F.size(F.try_variant_get(v, "$.datasets", "array<variant>")) == 0)), "datasets must be a non-empty list")
    )


def load(docs: DataFrame, body: str = "value", key: str | None = None) -> DataFrame:
    """(project, n, id, name, source_text, source_filename, extra_headers, blocks, active):
    a row per data set; a payload or data set that breaks the format raises when it is read.

    Missing and repeated ids are made anew from project and place; an active index out of range
    counts as 0; a source_path of old files gives its base name.
    """
    v = F.try_parse_json(F.col(body))
    d = docs.select((F.col(key) if key else F.lit("")).cast("string").alias("project"), v.alias("v"))
    bad = problem(F.col("v"))
    d = d.withColumn("v", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("project: "), bad)).cast("variant")).otherwise(F.col("v")))
    old = at(F.col("v"), "$.datasets").isNull()
    one = F.array(F.col("v"))
    e = d.select("project", old.alias("old"), F.coalesce(F.try_variant_get("v", "$.active_dataset_index", "int"), F.lit(0)).alias("active"), F.posexplode(F.when(old, one).otherwise(F.try_variant_get("v", "$.datasets", "array<variant>"))).alias("n", "x"))
    x = F.col("x")
    named = F.col("old") | (strip(F.coalesce(text_at(x, "$.name"), F.lit(""))) != "")
    listed = F.coalesce(kind(at(x, "$.blocks")) == "ARRAY", at(x, "$.blocks").isNull()) & F.coalesce(kind(at(x, "$.extra_headers")) == "ARRAY", at(x, "$.extra_headers").isNull())
    worded = F.coalesce(kind(at(x, "$.source_text")) == "STRING", at(x, "$.source_text").isNull()) & F.coalesce(kind(at(x, "$.source_filename")) == "STRING", at(x, "$.source_filename").isNull())
    why = F.when(~F.col("old") & (kind(x) != "OBJECT"), "is not an object").when(~named, "has no valid name").when(~F.col("old") & ~listed, "has no list").when(~F.col("old") & ~worded, "has no string")
    e = e.withColumn("x", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("dataset #"), (F.col("n") + 1).cast("string"), F.lit(" "), why)).cast("variant")).otherwise(x))
    from pyspark.sql import Window

    path = F.coalesce(text_at(x, "$.source_filename"), F.nullif(text_at(x, "$.source_path"), F.lit("")))
    r = e.select(
        "project", "n", text_at(x, "$.id").alias("id"), F.when(F.col("old"), "Data 1").otherwise(text_at(x, "$.name")).alias("name"),
        F.coalesce(F.when(F.col("old"), text_at(x, "$.input_text")).otherwise(text_at(x, "$.source_text")), F.lit("")).alias("source_text"), basename(path).alias("source_filename"),
        F.coalesce(F.try_variant_get(x, "$.extra_headers", "array<string>"), F.array().cast("array<string>")).alias("extra_headers"),
        F.coalesce(F.try_variant_get(x, "$.blocks", BLOCKS), F.array().cast(BLOCKS)).alias("blocks"), "active",
    )
    seen = F.row_number().over(Window.partitionBy("project", "id").orderBy("n"))
    count = F.max("n").over(Window.partitionBy("project")) + 1
    fresh = F.md5(F.concat_ws(":", "project", F.col("n").cast("string")))
    r = r.withColumn("id", F.when(F.col("id").isNull() | (F.col("id") == "") | (seen > 1), fresh).otherwise(F.col("id")))
    return r.withColumn("active", F.when(F.col("active").between(0, count - 1), F.col("active")).otherwise(0))


def read(spark: SparkSession, path: str) -> DataFrame:
    return load(spark.read.text(path, wholetext=True).withColumn("p", F.col("_metadata.file_path")), "value", "p")


def rows(datasets: DataFrame) -> DataFrame:
    """(dataset_id, bidx, ridx, idx, token, label, gloss) of loaded data sets."""
    b = datasets.select(F.col("id").alias("dataset_id"), F.posexplode("blocks").alias("bidx", "block"))
    return b.select("dataset_id", "bidx", F.posexplode("block").alias("ridx", "r")).select("dataset_id", "bidx", "ridx", "r.*")


def payload(datasets: DataFrame) -> DataFrame:
    """(project, value): each project as one JSON document of version 2."""
    item = F.struct("n", F.struct("id", "name", "source_text", "blocks", "extra_headers", basename(F.col("source_filename")).alias("source_filename")).alias("d"))
    g = datasets.groupBy("project").agg(F.array_sort(F.collect_list(item), lambda a, b: a["n"] - b["n"]).alias("ds"), F.max("active").alias("active"))
    return g.select("project", F.to_json(F.struct(F.lit(2).alias("version"), F.transform("ds", lambda x: x["d"]).alias("datasets"), F.col("active").alias("active_dataset_index"))).alias("value"))
