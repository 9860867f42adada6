"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SEGMENT = r"[A-Za-z0-9]+|[^\x00-\x7F](?:[A-Za-z0-9]|[^\x00-\x7F])*"
#: DuckDB macros written out as functions of an SQL expression.
def sql_tokens(x: str) -> str:  # noqa: E302
    part = lambda p: f"list_filter(list_transform(regexp_extract_all(s, '{p}'), lambda p: lower(p)), lambda p: strlen(p) >= 2 AND p <> lower(s))"
    parts = rf"CASE WHEN NOT regexp_matches(s, '.[A-Z]') THEN [] WHEN strlen(s) = length(s) THEN {part('^[^A-Z]+|[A-Z][^A-Z]*')} ELSE {part('^[^\\p{Lu}]+|\\p{Lu}[^\\p{Lu}]*')} END"
    return f"flatten(list_transform(list_filter(regexp_extract_all({x}, '{_SEGMENT}'), lambda s: strlen(s) >= 2), lambda s: list_concat({parts}, [lower(s)])))"


ENTRIES = """entries AS (
  SELECT d.doc_id AS entry_id, d.source AS topic, d.text AS body, [d.lang] AS tags, 28401120 + 60 * d.doc_id AS ts_min,
         CASE WHEN l.quality = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1)"""
CONV = """conv AS (
  SELECT 'conv-' || conv_id AS topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text AS body FROM conversations)"""
TOKENS = f"toks AS (SELECT entry_id, topic, ts_min, confidence, {sql_tokens('body')} AS ts FROM entries)"
TF = "tf AS (SELECT entry_id, term, count(*) AS tf FROM (SELECT entry_id, unnest(ts) AS term FROM toks) GROUP BY ALL)"


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def load() -> None:
    for m in ("search", "stats", "graph", "similar", "code", "sessions"):
        import_module(f"quillstone.plans.{m}")
