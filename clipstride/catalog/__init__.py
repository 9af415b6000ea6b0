"""Registered queries: each a Spark plan over the given tables and, where SQL can say
the same at full size, the equivalent SQL.

``@query(name, *views)`` registers a function ``(Tables) -> DataFrame``; its SQL is
given with ``sql(name, body, *views)`` and may use the named views of ``inputs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    from clipstride.catalog.inputs import Tables, with_views

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def load() -> None:
    from clipstride.catalog import (  # noqa: F401
        clips,
        detection,
        evaluation,
        lifecycle,
        moments,
        scalars,
        streams,
    )
