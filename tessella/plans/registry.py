"""Names of the engine's queries, their functions and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder of the tables); ``oracle`` is DuckDB SQL for the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = function
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return function

    return register


for _module in ("text_queries", "evidence_queries", "library_queries", "binding_queries", "record_queries", "grounding_queries"):
    import_module(f"tessella.plans.{_module}")
