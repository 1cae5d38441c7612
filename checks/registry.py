"""Name -> (Spark query, SQL) for every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; `sql` computes the same rows from the same tables."""

    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(tune(spark), sf_dir.rstrip("/"))

        run.__name__, run.__doc__ = name, query.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep
