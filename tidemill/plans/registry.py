"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.session import tune

TOPICS = ["profile", "checks", "jobs", "route", "model", "images", "sources", "streams"]

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [import_module(f"tidemill.plans.catalog.{t}") for t in TOPICS]


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _tuned(q) for m in _modules() for name, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.SQL.items()}
