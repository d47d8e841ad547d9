"""Readers of the driver's tables and pieces of SQL that several statements share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import DASHES, STOP_WORDS, SYNONYMS, TOKEN


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table; Python rows are turned into a local relation."""
    return spark.createDataFrame(rows, schema)


def quote(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quote, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql_values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({names})"


def sql_tokens(text: str) -> str:
    stop = quote(STOP_WORDS)
    return f"list_filter(regexp_extract_all(translate(lower(coalesce({text}, '')), '{DASHES}', '------'), '{TOKEN}'), lambda x: NOT list_contains({stop}, x))"


_SYN = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SYNONYMS.items()) + "}"


def sql_query_terms(text: str) -> str:
    t = sql_tokens(text)
    return f"list_distinct(list_concat({t}, list_filter(list_transform({t}, lambda x: {_SYN}[x]), lambda x: x IS NOT NULL)))"


SQL_INDEX = f"""
tok AS (SELECT doc_id AS id, {sql_tokens('text')} AS tokens FROM documents),
corpus AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
post AS (SELECT term, id, doc_len, count(*) AS tf FROM (SELECT id, len(tokens) AS doc_len, unnest(tokens) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
qt AS (SELECT item_id AS qid, unnest({sql_query_terms('text')}) AS term FROM benchmark),
hit AS (SELECT qid, id, term, df, idf, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) AS w FROM qt JOIN terms USING (term) JOIN post USING (term), corpus),
bm AS (SELECT qid, id, round(sum(w), 6) AS score FROM hit GROUP BY ALL)"""
