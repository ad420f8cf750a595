"""Named queries over the given tables, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            TWINS[name] = sql
        return query

    return add


def r6(column: Column | str) -> Column:
    """Comparable double: six decimals, nudged off exact ties, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(1.7e-8), 6) + F.lit(0.0)


def q6(expression: str) -> str:
    """SQL twin of ``r6``."""
    return f"(round({expression} + 1.7e-8, 6) + 0.0)"


# The record frames of teleproof.sources.tables in SQL: r is the acquisition row, t the time in seconds.
EV = """ev AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r,
  epoch_us(ts) / 1e6 AS t, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events)"""
LI = """li AS (SELECT l_suppkey AS record_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS r,
  epoch_us(l_shipdate) / 1e6 AS t, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""
ORD = """od AS (SELECT o_custkey AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r,
  o_orderkey, epoch_us(o_orderdate) / 1e6 AS t, o_totalprice, o_orderstatus FROM orders)"""
EM = """em AS (SELECT CAST(label AS BIGINT) AS record_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r,
  CAST(vec_id AS DOUBLE) AS t, """ + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(64)) + " FROM embeddings)"
# Whole record and two fixed windows of lineitem.
LI_WINDOWS = """w AS (SELECT record_id, CAST(0 AS BIGINT) AS a, max(r) + 1 AS b FROM li GROUP BY 1
  UNION ALL SELECT DISTINCT record_id, 0, 200 FROM li UNION ALL SELECT DISTINCT record_id, 200, 400 FROM li)"""
LI_LONG = """ll AS (SELECT record_id, r, t, 'l_quantity' AS channel, l_quantity AS v FROM li
  UNION ALL SELECT record_id, r, t, 'l_extendedprice', l_extendedprice FROM li
  UNION ALL SELECT record_id, r, t, 'l_discount', l_discount FROM li
  UNION ALL SELECT record_id, r, t, 'l_tax', l_tax FROM li)"""
