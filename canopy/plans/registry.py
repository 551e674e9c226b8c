"""Registry of queries: name to (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that files a query under ``name``."""

    def wrap(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = (query, sql)
        return query

    return wrap


def queries() -> dict[str, Query]:
    load()
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"canopy.plans.{name}")


MODULES = ("queries_graph", "queries_reach", "queries_more", "queries_parts", "queries_structure", "queries_members", "queries_live", "queries_deep", "queries_listings")
