"""The registry of named queries: a DataFrame function and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return add


def all_queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def _load() -> None:
    """Importing a module registers its queries."""
    from .operators import aggregates, basics, joins, ordering  # noqa: F401
    from .functions import families  # noqa: F401
    from .plans import texts, tools  # noqa: F401
