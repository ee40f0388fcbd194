"""The engine's own queries by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekframe.plans import oracles, queries as plans

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP: Query = plans.hybrid_search


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in plans.ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
