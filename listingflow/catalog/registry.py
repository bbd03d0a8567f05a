"""Registered queries: name -> Spark function and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import LISTING_SQL, listing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with its check."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def on_listing(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(listing_df)``; the SQL may use the ``listing`` view."""
    full = None if sql is None else f"WITH RECURSIVE {LISTING_SQL}{', ' + ctes if ctes else ''} {sql}"

    def add(fn: Callable[[DataFrame], DataFrame]):
        query(name, full)(lambda spark, sf_dir: fn(listing(spark, sf_dir)))
        return fn
    return add
