"""Key registry behind ``__spark_entry__``: key -> (Spark builder, DuckDB oracle text).

A builder takes ``(spark, sf_dir)`` and returns a lazily planned DataFrame over the driver's
tables (or the ERP tables Spark derives from them). Oracle text is optional: keys without it
get only the driver's weaker row-count check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers keys."""
    from . import keys_ops, keys_reports  # noqa: F401
