"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL of the same result."""

    def add(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return run

    return add
