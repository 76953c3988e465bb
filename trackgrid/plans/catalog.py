"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, the precision both engines are compared at."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def load() -> None:
    from trackgrid.plans import exports, streams, tiles, tracking, tradeoffs  # noqa: F401
