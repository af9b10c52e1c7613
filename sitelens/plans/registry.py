"""Registry of named queries (Spark) and their DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    # Importing the plan modules fills the registry.
    from sitelens.plans import (  # noqa: F401
        composed_plans,
        containment_plans,
        detail_plans,
        extract_plans,
        fetch_plans,
        keyword_plans,
        link_plans,
        merge_plans,
        more_plans,
        queue_plans,
        sink_plans,
        stream_plans,
        traverse_plans,
        usecase_plans,
    )
