"""Dictionary lookup: normal forms, providers, entries, and results that have grown stale.

A dictionary is a table (headword, entry) or a provider that is asked once per distinct form;
nothing here opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilim.functions import text as t

FOUND, NOT_FOUND, UNAVAILABLE, NETWORK_ERROR, STALE = "FOUND", "NOT_FOUND", "UNAVAILABLE", "NETWORK_ERROR", "STALE_RESULT"
# Names of parts of speech; other properties of a sense are usage labels.
PARTS_OF_SPEECH = ("isim", "fiil", "sıfat", "zarf", "zamir", "edat", "bağlaç", "ünlem", "sayı")
ENTRY = (
    "madde string, lisan string, telaffuz string, birlesikler string, atasozu array<struct<madde: string>>, deyimler array<struct<madde: string>>, "
    "anlamlarListe array<struct<anlam: string, ozelliklerListe: array<struct<tam_adi: string>>, orneklerListe: array<struct<ornek: string>>>>"
)
Provider = Callable[[str], str | None]


def text_list(value: Column) -> Column:
    """A delimited string as a list of non-blank parts; null gives the empty list."""
    return F.coalesce(F.filter(F.transform(F.split(value, r"[|;\n]"), t.strip), lambda x: x != ""), F.array().cast("array<string>"))


def entries(raw: DataFrame, body: str = "body") -> DataFrame:
    """raw with status and the parsed fields of the first entry: headword, origin, pronunciation,
    pos, senses (definition, usage, examples), compounds, idioms, raw. body is a JSON array of
    entries; an error object and an empty array are NOT_FOUND, anything else UNAVAILABLE."""
    b = F.col(body)
    arr = F.from_json(b, f"array<struct<{ENTRY}>>", {"mode": "PERMISSIVE"})
    blank = t.strip(F.coalesce(b, F.lit("")))
    status = F.when(blank.rlike(r'^\{.*"error"'), NOT_FOUND).when(blank.rlike(r"^\[\s*\]$"), NOT_FOUND).when(blank.rlike(r"^\[") & arr.isNotNull() & F.get(arr, F.lit(0))["madde"].isNotNull(), FOUND).otherwise(UNAVAILABLE)
    e = F.get(arr, F.lit(0))
    names = lambda s: F.transform(F.coalesce(s["ozelliklerListe"], F.array().cast("array<struct<tam_adi:string>>")), lambda x: x["tam_adi"])
    senses = F.transform(e["anlamlarListe"], lambda s: F.struct(s["anlam"].alias("definition"), F.filter(names(s), lambda x: ~x.isin(*PARTS_OF_SPEECH)).alias("usage"), F.transform(F.coalesce(s["orneklerListe"], F.array().cast("array<struct<ornek:string>>")), lambda x: x["ornek"]).alias("examples")))
    pos = F.get(F.filter(F.flatten(F.transform(e["anlamlarListe"], names)), lambda x: x.isin(*PARTS_OF_SPEECH)), F.lit(0))
    d = raw.withColumn("status", status)
    found = F.col("status") == FOUND
    return d.withColumns({
        "headword": F.when(found, e["madde"]), "origin": F.when(found, e["lisan"]), "pronunciation": F.when(found, e["telaffuz"]), "pos": F.when(found, pos), "senses": F.when(found, senses),
        "compounds": F.when(found, text_list(e["birlesikler"])), "idioms": F.when(found, F.transform(e["deyimler"], lambda x: x["madde"])), "raw": F.when(found, b),
    })


def lookup(terms: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """terms with query, status and body, joined by normal form; blank terms are NOT_FOUND.

    dictionary: (headword, body). from_cache marks all but the first occurrence of a form.
    """
    from pyspark.sql import Window

    q = terms.withColumn("query", t.dictionary_query(F.col(term)))
    forms = dictionary.select(t.dictionary_query(F.col("headword")).alias("query"), "body").groupBy("query").agg(F.min("body").alias("body"))
    j = q.join(forms, "query", "left")
    n = F.row_number().over(Window.partitionBy("query").orderBy(*[c for c in terms.columns]))
    return j.withColumns({"status": F.when((F.col("query") != "") & F.col("body").isNotNull(), FOUND).otherwise(NOT_FOUND), "from_cache": n > 1})


def ask(terms: DataFrame, provider: Provider, name: str, term: str = "term") -> DataFrame:
    """(query, provider, status, body) of each distinct form, asked once: None is NOT_FOUND,
    ConnectionError and TimeoutError NETWORK_ERROR, other exceptions UNAVAILABLE."""
    forms = terms.select(t.dictionary_query(F.col(term)).alias("query")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q in b["query"]:
                try:
                    body = provider(q) if q else None
                    out.append((q, name, FOUND if body is not None else NOT_FOUND, body))
                except (ConnectionError, TimeoutError):
                    out.append((q, name, NETWORK_ERROR, None))
                except Exception:
                    out.append((q, name, UNAVAILABLE, None))
            yield pd.DataFrame(out, columns=["query", "provider", "status", "body"])

    return forms.mapInPandas(run, "query string, provider string, status string, body string")


def mock(spark: SparkSession, words: dict[str, dict]) -> DataFrame:
    """A dictionary table of given entries, for tests and offline use."""
    return spark.createDataFrame([(w, json.dumps([e], ensure_ascii=False)) for w, e in words.items()], "headword string, body string")


def unavailable(query: str) -> str | None:
    raise RuntimeError("no dictionary is configured")


def terms_of(parsed: DataFrame) -> DataFrame:
    """(token, kind, term): the whole token, its root if it differs, and each segment."""
    root = F.when(F.lower("root") != F.lower("token"), F.array(F.struct(F.lit("root").alias("kind"), F.col("root").alias("term")))).otherwise(F.array().cast("array<struct<kind:string,term:string>>"))
    segs = F.transform("segments", lambda s: F.struct(F.lit("segment").alias("kind"), s.alias("term")))
    return parsed.select("token", F.explode(F.concat(F.array(F.struct(F.lit("token").alias("kind"), F.col("token").alias("term"))), root, segs)).alias("x")).select("token", "x.*")


def mark_stale(status: Column, terms: Column, snapshot: Column) -> Column:
    """STALE_RESULT where the terms have changed since the lookup."""
    return F.when(snapshot.isNotNull() & ~terms.eqNullSafe(snapshot), STALE).otherwise(status)
