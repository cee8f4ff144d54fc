"""All queries of the workbench and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; ``t`` gives a query the tables it names."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, tables: str, fn: Callable[..., DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in tables.split()])
        if sql:
            self.oracle[name] = sql


def collect() -> Registry:
    from . import analysis_queries, effect_queries, process_queries, quality_queries, series_queries, source_queries, step_queries, text_queries

    r = Registry()
    for module in (step_queries, quality_queries, analysis_queries, process_queries, text_queries, series_queries, effect_queries, source_queries):
        module.register(r)
    return r
