"""Registered queries of all operators."""

from __future__ import annotations


def _load():
    from tracewright.plans import registry
    from tracewright.plans import analyze_queries, answer_queries, attribute_queries, classify_queries, more_queries, recover_queries, represent_queries, source_queries, stream_queries  # noqa: F401

    return registry


def all_queries():
    """All queries by name; a cheap one first, as a session's first query also pays for its start."""
    found = _load().QUERIES
    return {k: found[k] for k in ("r2_kind_admission", *found)}


def all_sql():
    return _load().SQL
