"""Annotation of streams: the label cascade is stateless by line, so that it runs on a stream as
it does on a table; counts over time are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kilim.functions import text as t
from kilim.operators import labeling as lab


def labelled(stream: DataFrame, look: lab.Lookups, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, sent_no, pos, token, label, keep...): static lexicon joins only, append mode."""
    lines = F.filter(F.split(F.col(text), t.LINE), lambda x: x.rlike(t.SOLID))
    s = stream.select(key, *keep, F.posexplode(lines).alias("n", "line")).withColumn("sent_no", F.col("n") + 1)
    tok = s.select(key, *keep, "sent_no", F.posexplode(F.regexp_extract_all("line", F.lit(t.TOKEN), F.lit(0))).alias("pos", "token"))
    return lab.label(tok, look)


def label_counts(stream: DataFrame, look: lab.Lookups, at: str, window: str = "5 minutes", late: str = "10 minutes", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(start, label, n) per time window; rows later than `late` are dropped by the watermark."""
    tok = labelled(stream.withWatermark(at, late), look, key, text, keep=(at,))
    return tok.groupBy(F.window(at, window).alias("w"), "label").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")


def write_votes(stream: DataFrame, look: lab.Lookups, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Write each batch's labelled tokens and sentence votes under path, one folder a batch, so
    that a batch that runs again replaces its own output."""

    def put(df: DataFrame, epoch: int) -> None:
        tok, votes = lab.annotate(df, look, key=key, text=text)
        tok.select(key, "sent_no", "pos", "token", "label").write.mode("overwrite").parquet(f"{path}/tokens/batch={epoch}")
        votes.write.mode("overwrite").parquet(f"{path}/votes/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
