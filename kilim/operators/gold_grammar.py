"""Reading of gold CSV records (Token, Item, Label, Gloss) that may be broken.

A recursive-descent grammar reads one record at a time and tells where and why it stops:

    file   := record*
    record := field ("," field)* end
    field  := '"' (char | '""')* '"'  |  char without '"' and ','
    end    := "\\r"? "\\n" | "\\r"? end of text

After a syntax error in a file the parser resumes at the next line that is a validated
anchor: one that begins as a record of this format does and reads through without error.
An unterminated quote thus costs its own record, not the rest of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
LABELS = ("TR", "EN", "MIXED", "UID", "NE", "LANG3", "OTHER")
META_LABELS = {
    "SentenceID": re.compile(r"[0-9]*[1-9][0-9]*"),
    "MatrixLang": re.compile(r"TR|EN"),
    "EmbedLang": re.compile(r"TR|EN|-"),
}

WHOLE = re.compile(r"[0-9]*[1-9][0-9]*")
CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\x9f]")
ANCHOR = re.compile(r'(?:"?[0-9]+"?,|"?"?,"?(?:SentenceID|MatrixLang|EmbedLang)"?,|,,,\r?$)', re.M)

PARSED = "kind string, token long, item string, label string, gloss string, reason string, at int, detail string, long_token string"
"""token is null and long_token holds the digits of a Token of more than LONG digits."""
LONG = 18


class Syntax(Exception):
    """reason, and the offset in the text at which the grammar no longer holds."""

    def __init__(self, reason: str, at: int, detail: str):
        self.reason, self.at, self.detail = reason, at, detail


class Record(NamedTuple):
    kind: str | None
    token: int | None
    item: str | None
    label: str | None
    gloss: str | None
    reason: str | None
    at: int | None
    detail: str | None
    long_token: str | None = None


class Parser:
    """single: the text is one record, so that line feeds outside quotes are plain characters."""

    def __init__(self, text: str, single: bool = False):
        self.text, self.single, self.pos = text, single, 0
        self.stop = len(text) - text.endswith("\r") if single else len(text)

    def at_end(self) -> bool:
        if self.pos >= self.stop:
            return True
        return not self.single and (self.text[self.pos] == "\n" or self.text.startswith("\r\n", self.pos) or (self.text[self.pos] == "\r" and self.pos + 1 == self.stop))

    def record(self) -> list[tuple[str, int]]:
        fields = [self.field()]
        while not self.at_end():
            self.pos += 1  # field() stops only at a comma or at the end
            fields.append(self.field())
        return fields

    def field(self) -> tuple[str, int]:
        if self.pos < self.stop and self.text[self.pos] == '"':
            return self.quoted()
        return self.plain()

    def quoted(self) -> tuple[str, int]:
        start, parts = self.pos, []
        self.pos += 1
        while True:
            close = self.text.find('"', self.pos, self.stop)
            if close < 0:
                raise Syntax("QUOTING", start, "quoted field never ends")
            parts.append(self.text[self.pos : close])
            self.pos = close + 1
            if self.pos < self.stop and self.text[self.pos] == '"':
                parts.append('"')
                self.pos += 1
                continue
            if not self.at_end() and self.text[self.pos] != ",":
                raise Syntax("QUOTING", self.pos, "text after a closing quote")
            return "".join(parts), start

    def plain(self) -> tuple[str, int]:
        start = self.pos
        while not self.at_end() and self.text[self.pos] != ",":
            if self.text[self.pos] == '"':
                raise Syntax("QUOTING", self.pos, "quote inside an unquoted field")
            self.pos += 1
        return self.text[start : self.pos], start

    def end(self) -> None:
        if self.text.startswith("\r\n", self.pos):
            self.pos += 2
        elif self.pos < len(self.text):
            self.pos += 1


def typed(fields: list[tuple[str, int]]) -> Record:
    """The record's values, checked; raises Syntax at the first field that is wrong."""
    if len(fields) != 4:
        raise Syntax("COLUMNS", fields[min(len(fields), 5) - 1][1], f"{len(fields)} fields")
    for value, at in fields:
        if bad := CONTROL.search(value):
            raise Syntax("VALUE", at + bad.start(), "control character")
    (token, t_at), (item, i_at), (label, l_at), (gloss, _) = fields
    if token.strip():
        if not WHOLE.fullmatch(token):
            raise Syntax("VALUE", t_at, "Token is no positive whole number")
        if not item.strip():
            raise Syntax("VALUE", i_at, "blank Item")
        if label not in LABELS:
            raise Syntax("VALUE", l_at, "unknown Label")
        short = len(token) <= LONG
        return Record("token", int(token) if short else None, item, label, gloss, None, None, None, None if short else token)
    if not (item.strip() or label.strip() or gloss.strip()):
        return Record("blank", None, "", "", "", None, None, None)
    if item not in META_LABELS:
        raise Syntax("VALUE", i_at, "Item without Token")
    if not META_LABELS[item].fullmatch(label):
        raise Syntax("VALUE", l_at, f"Label of {item}")
    return Record("meta", None, item, label, gloss, None, None, None)


def failed(e: Syntax) -> Record:
    return Record(None, None, None, None, None, e.reason, e.at, e.detail)


def parse_line(raw: str | None) -> Record:
    """One delivered record. A null is a record without fields: COLUMNS at 0."""
    if raw is None:
        return failed(Syntax("COLUMNS", 0, "null record"))
    p = Parser(raw, single=True)
    try:
        return typed(p.record())
    except Syntax as e:
        return failed(e)


def parse_file(text: str | None) -> Iterator[tuple[int, Record]]:
    """(offset, record or error) for each record of a file's text; null and empty give none.

    After QUOTING the parser goes on at the next anchor line that itself reads as a record.
    """
    p = Parser(text or "")
    quotes: Quotes | None = None
    while p.pos < len(p.text):
        start = p.pos
        try:
            fields = p.record()
            p.end()
            yield start, typed(fields)
        except Syntax as e:
            yield start, failed(e)
            if e.reason == "QUOTING":
                quotes = quotes or Quotes(p.text)
                p.pos = resume(quotes, start)


class Quotes:
    """Where quoted fields close in a text, worked out once from its end to its start, so that
    trials at many anchors stay linear."""

    def __init__(self, text: str):
        self.text = text
        at = [m.start() for m in re.finditer('"', text)]
        self.close: dict[int, int] = {}
        """The closing quote of a field that opens at a quote; missing if it never ends."""
        for i in range(len(at) - 2, -1, -1):
            if i + 2 < len(at) and at[i + 2] == at[i + 1] + 1:  # a doubled quote inside
                if at[i + 2] in self.close:
                    self.close[at[i]] = self.close[at[i + 2]]
            else:
                self.close[at[i]] = at[i + 1]

    def shaped(self, pos: int) -> bool:
        """A record of four fields stands at pos, as far as quotes and commas tell."""
        text, stop = self.text, len(self.text)
        for k in range(4):
            if text.startswith('"', pos):
                if pos not in self.close:
                    return False
                pos = self.close[pos] + 1
            else:
                found = PLAIN_FIELD.match(text, pos)
                pos = found.end()
            last = pos >= stop or text[pos] == "\n" or text.startswith("\r\n", pos) or (text[pos] == "\r" and pos + 1 == stop)
            if last or text[pos] != ",":
                return last and k == 3
            pos += 1
        return False


PLAIN_FIELD = re.compile(r'(?:[^",\r\n]|\r(?!\n|\Z))*')


def resume(quotes: Quotes, start: int) -> int:
    """Offset of the first validated anchor after the line that begins at start."""
    line = quotes.text.find("\n", start)
    while line >= 0:
        if ANCHOR.match(quotes.text, line + 1) and quotes.shaped(line + 1):
            return line + 1
        line = quotes.text.find("\n", line + 1)
    return len(quotes.text)


def parse_lines(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """df with the column `parsed` (see PARSED): a typed record, or the reason, place and detail.

    Nulls: COLUMNS. An empty text is one field: COLUMNS. Rows keep their number and order;
    other columns pass through, whatever their names (one named `parsed` is replaced).
    """

    @F.pandas_udf(PARSED)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_line(None if x is None else x) for x in s], columns=Record._fields).astype({"token": "Int64", "at": "Int32"})

    return df.withColumn("parsed", parse(F.col(raw)))


def parse_files(df: DataFrame, text: str = "value", name: str | None = None) -> DataFrame:
    """One row per record of each file's whole text: (file, offset, the fields of PARSED)."""
    key = F.col(name).cast("string") if name else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, o, *r) for f, t in zip(b["file"], b["text"]) for o, r in parse_file(t)]
            yield pd.DataFrame(rows, columns=["file", "offset", *Record._fields]).astype({"token": "Int64", "at": "Int32"})

    return df.select(key.alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, offset long, " + PARSED)


FILE_LINES = 4096


def parse_delivered_files(df: DataFrame, file: str = "file_name", number: str = "line_no", key: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """parse_files over the lines of each file put together again in their order.

    A file of any size goes in parts of FILE_LINES line numbers, each of which begins with a
    delivered record; `file` names the file and its part. Rows without a number are ordered by
    key, null lines and repeats left out; lines without a file make up a file without a name.
    """
    rows = df.where(F.col(raw).isNotNull()).select(F.coalesce(F.col(file), F.lit("")).alias("name"), F.coalesce(F.col(number).cast("long"), F.col(key)).alias("no"), F.col(key).alias("id"), F.col(raw).alias("raw")).distinct()
    part = F.floor(F.col("no") / FILE_LINES)
    lines = rows.groupBy("name", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("no", "id", "raw"))).alias("lines"))
    return parse_files(lines.select(F.concat_ws("#", "name", "part").alias("name"), F.array_join("lines.raw", "\n").alias("value")), "value", "name")


def bad_lines(df: DataFrame, key: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """(key, reason) of the records that don't parse, once each."""
    return parse_lines(df.select(key, raw)).where("parsed.reason is not null").select(key, F.col("parsed.reason").alias("reason")).distinct()


def good_lines(df: DataFrame, key: str = "line_id", raw: str = "raw_line", long_tokens: bool = False) -> DataFrame:
    """(key, kind, token, item, label, gloss) of the records that parse, once each; with
    long_tokens also long_token, see PARSED."""
    extra = ("long_token",) if long_tokens else ()
    p = parse_lines(df.select(key, raw)).where("parsed.reason is null")
    return p.select(key, *(F.col(f"parsed.{c}").alias(c) for c in ("kind", "token", "item", "label", "gloss", *extra))).distinct()


def located_errors(df: DataFrame, key: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """(key, reason, at, detail) of the records that don't parse, once each."""
    p = parse_lines(df.select(key, raw)).where("parsed.reason is not null")
    return p.select(key, *(F.col(f"parsed.{c}").alias(c) for c in ("reason", "at", "detail"))).distinct()
