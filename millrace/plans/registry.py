"""Named queries over a lake, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import oracle
from millrace.sources.lake import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str, name: str | None = None):
    """Register a function of a lake under its name. ``sql`` may read the logical ``tables``."""

    def register(f: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Lake(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle.sql(sql, *tables)
        return f

    return register
