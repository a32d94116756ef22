"""Registration of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderweave.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views of sources/tables.py.
EXPECTED = "expected AS (SELECT l_orderkey AS tray, l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"
CHECKED = "checked AS (SELECT l_orderkey AS tray, l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"
WRONG = "wrong AS (SELECT l_orderkey AS tray, l_partkey AS item, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1, 2)"
MENU = "menu AS (SELECT p_partkey AS pos, p_name AS name, [p_type, p_brand] AS sub_items FROM part)"
DETS = """dets AS (SELECT event_id AS det, ts, user_id AS tray, CAST(ts AS DATE) AS day, event_type AS cls, value / 500 AS score, CAST(props->>'$.k' AS INTEGER) AS cell, value FROM events),
boxes AS (SELECT *, CAST(cell % 10 * 10 AS DOUBLE) AS cx, CAST(cell // 10 * 10 AS DOUBLE) AS cy, value % 20 + 5 AS w, CAST(det % 15 + 5 AS DOUBLE) AS h, det % 8 * (3.141592653589793::DOUBLE / 16) AS r FROM dets)"""
TOKENS = "toks AS (SELECT vec_id AS crop, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 10) % 5 AS INTEGER)) AS tokens, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS best, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def query(name: str, sql: str | None = None):
    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return wrap
