"""Name -> (query, oracle SQL) registry of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query; a name can be registered once."""
    if name in _QUERIES:
        raise ValueError(f"query {name!r} is already registered")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def _load() -> None:
    from inkfold.plans import catalogue, geometry  # noqa: F401  register on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
