"""Where queries and their check SQL are registered, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoebox.plans.duck_views import with_views
from shoebox.sources.derived import Library

QUERIES: dict[str, Callable[[Library], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (), instead: dict | None = None):
    def register(fn: Callable[[Library], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, views, instead)
        return fn

    return register


_libraries: dict[tuple[str, str], Library] = {}


def library(spark: SparkSession, folder: str) -> Library:
    """One ``Library`` per application and folder, so that queries share a scan's written results."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _libraries:
        _libraries[key] = Library(spark, folder)
    return _libraries[key]


def runner(fn: Callable[[Library], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(library(spark, folder))
