"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def ntz(c: str | Column) -> Column:
    """Timestamps leave as wall-clock UTC without zone so both engines agree."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def r4(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 4)


def load_all() -> None:
    # importing the catalog modules fills the registry
    from . import (catalog_analytics, catalog_code, catalog_deps, catalog_graph, catalog_logs, catalog_otlp,  # noqa: F401
                   catalog_models, catalog_parse, catalog_sources, catalog_streams, catalog_triage,
                   catalog_vectors)
