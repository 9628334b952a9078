"""The registered queries: by name a function of (spark, folder), and the statement that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes, datasets, files, filters, nested, traces, tracks

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (boxes, tracks, files, filters, traces, datasets, nested)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
