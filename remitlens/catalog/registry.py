"""Named queries, each with its SQL twin where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the operator ids it shows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def r6(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else "value"))


def s6(expr: str, name: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE) AS {name}"
