"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries.frames import Frames, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, frames: str = "", sql: str | None = None):
    """Register ``fn(frames) -> DataFrame`` and, where SQL can say it, the same question."""

    def add(fn: Callable[[Frames], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Frames(spark, folder))
        if sql is not None:
            ORACLES[name] = duck(frames, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums depend on the order of their terms."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])
