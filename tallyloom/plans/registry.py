"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Views`, with SQL over the same views."""

    def register(f: Callable[[Views], DataFrame]):
        _queries[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            _sql[f.__name__] = with_views(sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def _load() -> None:
    from . import chart_queries, command_queries, function_queries, ledger_queries, numeric_queries, rule_queries  # noqa: F401
