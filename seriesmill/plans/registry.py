"""Queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


#: SQL of the bridge: events with milliseconds and label text, their series, and label pairs of these.
KEY = "'__name__:' || event_type || ';cluster:c' || (user_id % 2) || ';instance:i' || (user_id % 10) || ';job:job' || (user_id % 3) || ';user:' || user_id || ';'"
EVENTS = f"ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, user_id, value, props, {KEY} AS ls_key FROM events)"
SERIES = f"series AS (SELECT DISTINCT event_type, user_id, {KEY} AS ls_key FROM events)"
PAIRS = "pairs AS (SELECT ls_key, unnest(['__name__', 'cluster', 'instance', 'job', 'user']) AS name, unnest([event_type, 'c' || (user_id % 2), 'i' || (user_id % 10), 'job' || (user_id % 3), user_id::VARCHAR]) AS value FROM series)"
AS_KEY = "string_agg(name || ':' || value || ';', '' ORDER BY name)"
