"""Queries over the library's own operators, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: shifts of the depth surface from matched keypoints."""
    return QUERIES["surface_shift"](spark, sf_dir)


from . import queries_boxes, queries_scalar, queries_strip, queries_views  # noqa: E402, F401
