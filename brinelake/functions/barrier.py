"""Evaluate an expression once, however often and wherever its result is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Like ``withColumns``, but the optimizer cannot copy the expressions into later uses.

    Projections are merged, and filters move below them, by copying expressions: into every
    element of a later array function, or once into the filter and once more above it.  A
    generator over one struct stops both, at the price of one small row per input row.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.inline(F.array(packed)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Inside one expression: name a value and use it any number of times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
