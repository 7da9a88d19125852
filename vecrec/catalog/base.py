"""Registration of named queries with their DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def unit(v: str) -> str:
    """DuckDB text: list scaled to unit length, norm clipped at 1e-12."""
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def mean_cte(name: str, source: str, key: str, vector: str) -> str:
    """DuckDB CTEs: ``name(key, n, mean, vector)`` = plain mean and its unit vector per key."""
    return f"""{name}_d AS (
  SELECT {key}, i, avg(x) AS m, count(*) AS n
  FROM (SELECT {key}, unnest(range(1, len({vector}) + 1)) AS i, unnest({vector}) AS x FROM {source}) GROUP BY {key}, i),
{name}_m AS (SELECT {key}, max(n) AS n, list(m ORDER BY i) AS mean FROM {name}_d GROUP BY {key}),
{name} AS (SELECT {key}, n, mean, {unit('mean')} AS vector FROM {name}_m)"""
