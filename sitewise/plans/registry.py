"""Registry of named queries with their SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.plans.bridge import CELLS_CTE, MEMBERS_CTE, NETWORK_CTE, SAMPLES_CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``{samples}``, ``{cells}``, ``{network}`` and ``{members}`` in the SQL
    stand for the derived tables."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            sql = oracle
            for key, text in (("samples", SAMPLES_CTE), ("cells", CELLS_CTE),
                              ("network", NETWORK_CTE), ("members", MEMBERS_CTE)):
                sql = sql.replace("{" + key + "}", text)
            ORACLES[name] = sql
        return fn
    return add
