"""Where queries and their SQL counterparts are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qalake.sources.tables import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Views of one folder of tables, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, plan: Callable[[Views], DataFrame], sql: str | None = None, views: str = "") -> None:
    """List a query; sql: the same rows in DuckDB, over the views named."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
    if sql:
        ORACLES[name] = with_views(sql, *views.split()) if views else sql
