"""Registry of queries (spark, folder) -> DataFrame and of the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def by_code_point(sql: str) -> str:
    """sql with reverse(x), which DuckDB does by grapheme, written as a reversal of code points."""
    out, at = [], 0
    while (i := sql.find("reverse(", at)) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            out.append(sql[at : i + 8])
            at = i + 8
            continue
        depth, j, quoted = 1, i + 8, False
        while depth:
            c = sql[j]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            j += 1
        inner = by_code_point(sql[i + 8 : j - 1])
        out += [sql[at:i], f"array_to_string(list_reverse(regexp_extract_all({inner}, '(?s).')), '')"]
        at = j
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = by_code_point(sql)
        return f

    return add
