"""Registered queries over the driver's tables."""

from __future__ import annotations


def _load() -> None:
    from camwatch.plans import event_queries, scalar_queries, store_queries, video_queries  # noqa: F401


def all_queries() -> dict:
    """Every query by name."""
    _load()
    from camwatch.plans.registry import QUERIES

    return QUERIES


def all_sql() -> dict[str, str]:
    """The SQL of the queries that SQL can express."""
    _load()
    from camwatch.plans.registry import SQL

    return SQL
