"""Where queries and their oracles meet."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetshape.session import configure_fleet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that must give the same rows."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = wraps(fn)(lambda spark, sf_dir: fn(configure_fleet(spark), sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep
