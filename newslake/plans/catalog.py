"""Registered queries: one per operator (or report) of the inventory, each a
``(spark, sf_dir) -> DataFrame`` plan over the driver tables, with a DuckDB
oracle where the semantics are SQL-expressible.

Output conventions shared with the oracles: doubles rounded to 6 places,
timestamps as ISO-Z strings, arrays sorted where their order is not part of
the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from newslake.plans import (q_core, q_graph, q_reports, q_sinks, q_streams, q_text,  # noqa: F401
                                q_topics, q_writes)
