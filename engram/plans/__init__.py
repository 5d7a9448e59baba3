"""Registered queries and the views they read."""

from __future__ import annotations


def _load() -> None:
    from engram.plans import (  # noqa: F401
        queries_aggregates,
        queries_filters,
        queries_graph,
        queries_jobs,
        queries_tables,
    )


def all_queries() -> dict:
    from engram.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    from engram.plans.registry import CHECKS

    _load()
    return dict(CHECKS)
