"""The annotated table as text: tab-separated blocks, CoNLL-like, JSON records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilim.functions import text as t
from kilim.operators.corpus import KEYS, renumber, sentence_meta


def line(fields: list[Column]) -> Column:
    """Fields joined by tabs, blank ones at the end left out."""
    return F.regexp_replace(F.array_join(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), "\t"), r"(?:\t[\s]*)+$", "")


def joined(column: str, order: list[str], by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, column))), lambda x: x[column]), by)


def block_texts(rows: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """(keys, text): each sentence as lines idx, token, label, gloss, extras; rows without token
    left out, numbers made anew."""
    r = renumber(rows)
    body = [F.col("token"), F.col("label"), F.col("gloss"), *map(F.col, extras)]
    ln = F.when(F.col("idx").isNull(), line(body)).otherwise(line([F.col("idx").cast("string"), *body]))
    return r.select(*KEYS, "ridx", F.when(F.coalesce("token", F.lit("")) != "", ln).alias("line")).groupBy(*KEYS).agg(joined("line", ["ridx"], "\n").alias("text"))


def dataset_texts(rows: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """(dataset_id, text): the sentences joined by a blank line."""
    return block_texts(rows, extras).groupBy("dataset_id").agg(joined("text", ["bidx"], "\n\n").alias("text"))


def parse_annotated(texts: DataFrame, key: str = "dataset_id", text: str = "text") -> DataFrame:
    """(key, bidx, ridx, token, label): sentences parted by blank lines; of two fields token and
    label, of more the second and third; without tabs, a word and a label in capitals. Lines
    that are none of these are left out, glosses are not read."""
    b = texts.select(key, F.posexplode(F.split(F.col(text), "\n\n")).alias("bidx", "block"))
    lines = F.filter(F.transform(F.split("block", t.LINE), t.strip), lambda x: x != "")
    ln = b.select(key, "bidx", F.posexplode(lines).alias("n", "line")).withColumn("f", F.split("line", "\t"))
    word = r"^(\S+)\s+(TR|EN|MIXED|UID|NE|LANG3|OTHER)$"
    n = F.size("f")
    at = lambda i: t.strip(F.get("f", F.lit(i)))
    tok = F.when(n == 2, at(0)).when(n > 2, at(1)).when(F.col("line").rlike(word), F.regexp_extract("line", word, 1))
    lab = F.when(n == 2, at(1)).when(n > 2, at(2)).otherwise(F.regexp_extract("line", word, 2))
    from pyspark.sql import Window

    out = ln.select(key, "bidx", "n", tok.alias("token"), lab.alias("label")).where("token is not null")
    return out.withColumn("ridx", F.row_number().over(Window.partitionBy(key, "bidx").orderBy("n")) - 1).select(key, "bidx", "ridx", "token", "label")


def block_kinds(blocks: DataFrame, text: str = "text") -> DataFrame:
    """blocks with `lines`: array of (kind, token, label, raw), kind blank, meta, token or raw;
    only lines of exactly two fields are read."""

    def kind(x: Column) -> Column:
        f = F.split(x, "\t")
        two = F.size(f) == 2
        k = F.when(t.strip(x) == "", "blank").when(~two, "raw").when(t.is_meta(F.get(f, F.lit(0))), "meta").otherwise("token")
        return F.struct(k.alias("kind"), F.when(two, F.get(f, F.lit(0))).alias("token"), F.when(two, F.get(f, F.lit(1))).alias("label"), x.alias("raw"))

    return blocks.withColumn("lines", F.transform(F.split(F.col(text), "\n"), kind))


def field(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")


def conll(rows: DataFrame) -> DataFrame:
    """(keys, chunk): a sentence with its comments and lines index, token, label, gloss or _."""
    from pyspark.sql import Window

    lex = rows.where(~t.is_meta(F.col("token"))).withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ridx")))
    gloss = F.coalesce(F.nullif(field(t.strip(F.col("gloss"))), F.lit("")), F.lit("_"))
    body = lex.withColumn("line", F.concat_ws("\t", F.col("i").cast("string"), field(F.col("token")), field(F.col("label")), gloss)).groupBy(*KEYS).agg(joined("line", ["i"], "\n").alias("body"))
    opt = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"# {name} = "), field(F.col(c))))
    j = sentence_meta(rows).join(body, list(KEYS), "left")
    return j.select(*KEYS, F.concat_ws("\n", F.concat(F.lit("# sent_id = "), field(F.col("sent_id"))), opt("matrix_lang", "matrix_lang"), opt("embedded_lang", "embed_lang"), "body").alias("chunk"))


def conll_texts(rows: DataFrame) -> DataFrame:
    head = "# CoNLL export\n# columns = TokenIndex Token Label Gloss"
    return conll(rows).groupBy("dataset_id").agg(F.concat(F.lit(head + "\n\n"), joined("chunk", ["bidx"], "\n\n"), F.lit("\n")).alias("text"))


def sentence_records(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(dataset_id, bidx, sentence_id, dataset, source_text, matrix_lang, embedded_lang, tokens);
    names: (dataset_id, name)."""
    from pyspark.sql import Window

    lex = rows.where(~t.is_meta(F.col("token"))).withColumn("index", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ridx")))
    part = F.struct("index", F.coalesce("token", F.lit("")).alias("token"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("gloss", F.lit("")).alias("gloss"))
    tok = lex.groupBy(*KEYS).agg(F.array_sort(F.collect_list(part)).alias("tokens"))
    j = sentence_meta(rows).join(tok, list(KEYS), "left")
    j = j.join(names, "dataset_id", "left") if names is not None else j.withColumn("name", F.lit(""))
    empty = F.array().cast("array<struct<index:int,token:string,label:string,gloss:string>>")
    toks = F.coalesce("tokens", empty)
    return j.select(*KEYS, F.col("sent_id").alias("sentence_id"), F.coalesce("name", F.lit("")).alias("dataset"), F.array_join(F.transform(toks, lambda x: x["token"]), " ").alias("source_text"), "matrix_lang", F.col("embed_lang").alias("embedded_lang"), toks.alias("tokens"))


def write(rows: DataFrame, path: str, kind: str, names: DataFrame | None = None) -> None:
    """Write all data sets as txt, csv, conll or jsonl under path, parted by data set."""
    if kind == "txt":
        dataset_texts(rows).write.partitionBy("dataset_id").text(path)
    elif kind == "conll":
        conll_texts(rows).write.partitionBy("dataset_id").text(path)
    elif kind == "jsonl":
        sentence_records(rows, names).drop("bidx").write.partitionBy("dataset_id").json(path)
    elif kind == "csv":
        renumber(rows).select("dataset_id", "bidx", "ridx", "idx", "token", "label", "gloss").sortWithinPartitions("bidx", "ridx").write.partitionBy("dataset_id").csv(path, header=True)
    else:
        raise ValueError(f"unknown export format: {kind}")


def grid_text(view: DataFrame, cells: str = "cells", order: str = "vis_r") -> DataFrame:
    """(dataset_id, text) of a grid: cells (idx, then the columns) joined by tabs, a blank idx left
    out, blank cells at the end trimmed, blank rows as blank lines, none at the end."""
    c = F.transform(F.col(cells), lambda x: F.coalesce(x, F.lit("")))
    body = F.when(t.strip(F.get(c, F.lit(0))) == "", F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.concat(F.array(t.strip(F.get(c, F.lit(0)))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))))
    ln = F.regexp_replace(F.array_join(body, "\t"), r"(?:(?:^|\t)[\s]*)+$", "")
    return view.select("dataset_id", order, ln.alias("line")).groupBy("dataset_id").agg(F.regexp_replace(joined("line", [order], "\n"), r"\n+$", "").alias("text"))


def write_frequencies(frequencies: DataFrame, path: str) -> None:
    """Token, Frequency, LabelBreakdown as CSV, most frequent first, then by token."""
    f = frequencies.select(F.col("token").alias("Token"), F.col("n").alias("Frequency"), F.col("breakdown").alias("LabelBreakdown"))
    f.orderBy(F.desc("Frequency"), "Token").write.csv(path, header=True)
