"""Register a query function and, where SQL can say the same, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loantriad.plans.loans import LOANS_CTE

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, loans: bool = False, recursive: bool = False):
    """``loans`` puts the loan tables ``loans`` and ``scored`` in front of ``sql``."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = f"with {LOANS_CTE}\n{sql.strip()}" if loans else sql.strip()
        return fn

    return add
