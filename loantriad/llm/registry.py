"""Corpus queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CORPUS_CHECKS: dict[str, str] = {}


def corpus_query(name: str, sql: str | None = None):
    def add(fn):
        CORPUS_QUERIES[name] = fn
        if sql is not None:
            CORPUS_CHECKS[name] = sql.strip()
        return fn

    return add
