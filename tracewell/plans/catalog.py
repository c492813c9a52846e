"""Every registered query of the library and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.activity import SQL, Activity

#: The window and the clock of the queries; operators take both as arguments.
START, END = datetime(2024, 1, 15, tzinfo=timezone.utc), datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW = END

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def on_activity(name: str, sql: str | None = None) -> Callable[[Callable[[Activity], DataFrame]], None]:
    """Registers a query over the session views; ``sql`` goes on after the views."""

    def add(f: Callable[[Activity], DataFrame]) -> None:
        _QUERIES[name] = lambda spark, sf_dir: f(Activity(spark, sf_dir))
        if sql:
            _SQL[name] = SQL + sql

    return add


def on_tables(name: str, sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], None]:
    """Registers a query over the raw tables; the query gets a reader by table name."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
        _QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            _SQL[name] = sql

    return add


def _load() -> None:
    from tracewell.plans import asset_queries, call_queries, friction_queries, ordered_queries, session_queries, shell_queries, source_queries, text_queries  # noqa: F401  each registers its queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
