"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tideline.catalog.registry import QUERIES, SQL

_GROUPS = ["scalars", "series", "summaries", "assessment", "learning", "fitted"]


def _load() -> None:
    for group in _GROUPS:
        import_module(f"tideline.catalog.{group}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from tideline.catalog.assessment import flagship as run

    return run(spark, sf)
