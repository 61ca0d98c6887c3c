"""A streaming query: the cascade over the documents as a stream, each batch written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kilim.plans.annotation import VOTES, lookups, sql_labels
from kilim.plans.registry import query
from kilim.session import shared_dir
from kilim.streaming.annotate import write_votes


@query("stream_votes", f"with {sql_labels()}, {VOTES} select doc_id, sent_no, matrix_lang, embed_lang, n_tokens from votes")
def stream_votes(spark: SparkSession, d: str) -> DataFrame:
    """Sentence votes by a stream that takes what is there and stops."""
    path = f"{d}/documents.parquet"
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)  # streams read folders, not files
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    stream = stream.select("doc_id", "text")
    write_votes(stream, lookups(spark, d), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data/votes").drop("batch")
