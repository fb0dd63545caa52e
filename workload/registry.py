"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def chunks_cte(budget: int = 512, name: str = "chunks", source: str = "documents") -> str:
    """The chunk table in SQL: chunk_id, source_id, source_collection_id, lang,
    text, token_count."""
    return f"""{name} AS (
      SELECT doc_id || '_' || s AS chunk_id, doc_id AS source_id,
             cid AS source_collection_id, lang,
             array_to_string(list_slice(w, {budget} * s + 1, {budget} * (s + 1)), '') AS text,
             CAST(least({budget}, len(w) - {budget} * s) AS INTEGER) AS token_count
      FROM (SELECT *, unnest(range(0, (len(w) + {budget - 1}) // {budget})) AS s
            FROM (SELECT doc_id, cid, lang,
                         CASE WHEN len(t) = 0 THEN ['source_' || doc_id] ELSE t END AS w
                  FROM (SELECT doc_id, lang, CAST(substr(source, 4) AS BIGINT) AS cid,
                               regexp_extract_all(text, '\\s*\\S+(?:\\s+\\z)?') AS t
                        FROM {source}))))"""


CHUNKS = chunks_cte()
