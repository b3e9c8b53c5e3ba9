"""Named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projection import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan builder under a name, with SQL for another engine if there is any."""

    def add(build: Callable[[Tables], DataFrame]):
        _QUERIES[name] = build
        if sql:
            _SQL[name] = sql
        return build

    return add


def _load() -> None:
    from . import explain, feed, graph, language, paths, traversals  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir))) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
