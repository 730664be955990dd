"""Registered queries and, where SQL can say the same, their DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnish.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes: ``Tables(spark, folder).lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def load_all() -> None:
    from tarnish.plans import (  # noqa: F401
        encoder_queries, exact_model_queries, fuzzy_queries, model_queries, prepare_queries, report_queries,
        source_queries, table_queries, text_queries)
