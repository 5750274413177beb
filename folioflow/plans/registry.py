"""The library's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, chunks, knowledge, library, logs, search

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (catalog, chunks, search, knowledge, library, logs)

QUERIES: dict[str, Query] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP: Query = search.hybrid_search
