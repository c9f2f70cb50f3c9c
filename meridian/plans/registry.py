"""Registered queries: a function over the tables, and the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(tables) under its name. sql may start with WITH to add table expressions to the derived tables."""
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            head = with_clause()
            if body.upper().startswith("WITH RECURSIVE "):
                head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), "WITH " + body[15:]
            ORACLE[key] = head + (", " + body[5:] if body.upper().startswith("WITH ") else body)
        return f

    return register
