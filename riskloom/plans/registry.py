"""Registry of named queries: a Spark builder and, where SQL can express it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, *operators: str):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco
