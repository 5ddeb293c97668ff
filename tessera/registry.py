"""Every query of the engine by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, context, corpus, feeds, packages, retrieval, scopes, selection, web

ALL = context.QUERIES | retrieval.QUERIES | analytics.QUERIES | corpus.QUERIES | web.QUERIES | packages.QUERIES | selection.QUERIES | scopes.QUERIES | feeds.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
