"""All registered queries by name, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Modules of docuflux.plans that register queries.
MODULES = ("text", "guards", "retrieval", "ingest", "structure", "hierarchy", "layout", "blocks", "tables", "lists", "hybrid", "writers", "piped", "said", "operations")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) as query `name`."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered already")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"docuflux.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
