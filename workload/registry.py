"""Registry of runnable queries: a Spark function and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(fn):
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return register
