"""Registered queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.fixtures import BASE_SQL, trace_events, traces
from tracewright.tables import durable_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def on_base(sql: str) -> str:
    """SQL over the tables ev and tr: a SELECT, or further named tables and a SELECT."""
    return f"WITH {BASE_SQL}{'' if sql.lstrip().upper().startswith('SELECT') else ', '}{sql}"


def trace_query(name: str, sql: str | None = None, kept: bool = False):
    """A query over (events, traces) of the event table; both are derived once and kept by trace for queries of many branches."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            keep = (lambda d: durable_by(d, "trace_id")) if kept else (lambda d: d)
            events = keep(trace_events(spark, sf_dir))
            return f(events, keep(traces(events)))

        query(name, on_base(sql) if sql else None)(run)
        return f

    return add
