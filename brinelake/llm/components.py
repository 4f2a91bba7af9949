"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelake.llm.common import dropped, stored, written


def _distinct(links: DataFrame) -> DataFrame:
    return links.where(F.col("u") != F.col("v")).distinct()


def _folders(df: DataFrame) -> list[str]:
    return sorted({os.path.dirname(f) for f in df.inputFiles()})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the
    smallest node around it, then every smaller neighbour is. The number of links never grows and
    the rounds grow with the logarithm of the longest path. Each round is written, which cuts the
    lineage, and goes when the next one stands; joins are on single nodes, so a node with very many links is split by the adaptive
    skew join, and its minimum is combined in each task before the shuffle. Links with a null end
    and links of a node to itself are left out.
    """
    u, v, spark = F.col(a), F.col(b), links.sparkSession
    now = stored(_distinct(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                           .where(u.isNotNull() & v.isNotNull())), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = _distinct(both.where(F.col("v") > F.col("u")).join(least, "u")
                          .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = now
        now = stored(_distinct(small.union(least.select("u", F.col("m").alias("v")))), "links")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, _folders(last) + _folders(large))
        if after == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out = written(roots, "roots")
            dropped(spark, _folders(now))
            return out
        before = after
