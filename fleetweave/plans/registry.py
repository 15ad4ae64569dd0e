"""All queries of the core by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a `(spark, directory) -> DataFrame` under `name`."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from fleetweave.plans import data_quality, feed_queries, linking_queries, mart_queries, pipeline_queries, scalar  # noqa: F401
    from fleetweave.plans import device_queries  # noqa: F401
