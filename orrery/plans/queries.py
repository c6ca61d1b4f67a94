"""All queries of the library but those of the optional text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, building, empire, files, history, idioms, logs, market, pages, relational, stations, stores, views, world  # noqa: F401 - those that use relational's registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | views.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLES | views.ORACLES
