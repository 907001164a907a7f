"""All queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with equivalent DuckDB SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["word_top_forms"](spark, sf_dir)


from . import formats, geometry, lines, packages, pages, reconcile, selections, study, texts, words  # noqa: E402, F401
