"""Registry of the queries over the driver tables and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the canonical frames of ``events``.
EV = "ev AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS state, value AS x, event_id FROM events)"
#: Macrostates of the event types, by their first letter's place in the alphabet.
MACRO_SQL = "(ascii(state) % 2)"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
