"""Mixing sources to target weights by entropy balancing.

Each source gets a number of words to give. Among all rates per document that give it, the
balanced ones stay closest in relative entropy to taking every document once: minimise
sum r log r - r subject to sum size * r = target and 0 <= r <= 3. The dual has one multiplier per
source, the optimum is the exponential tilt r = min(3, exp(lambda * size)), and lambda is found by
Newton's method on the logarithm of the constraint, kept inside a bracket. An iteration is one
aggregation over (source, size) cells, which hold every document; nothing is collected but two
numbers that say whether to go on.

Rates become whole copies by error diffusion: documents of a source are dealt to buckets of a few
thousand by a hash, and inside a bucket, from long to short, each takes the number of copies that
brings the words taken so far nearest to the words due so far. The error of a bucket is about half
of its smallest document; a document is never taken more than three times.

Defined cases: a null or blank text has size zero and is taken zero times; a null source is a
source of its own, last; a source without words has target zero; repeated rows are documents of
their own, with the same total whichever of them is called which; the result depends on ids,
texts and places in files and not on partitions; other columns are carried under names of
position, so that none can clash with a name used here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.common import own_names, restored, row_keyed, words, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
BUCKET = 4096
TOLERANCE = 1e-9
STEPS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, n, target): the weights' shares of all words, none over its limit.

    Sources are in code point order, null last. The excess of a source at its limit is shared by
    weight among the others until none is above; so targets are ``least(limit * size, level *
    weight)``, and the level is found from running sums over sources ordered by limit per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = W.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    per = written(per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1)
                                 .cast("double")), "mix-sources")
    full = (limit * F.col("source_size")).cast("double")
    by = W.orderBy(full / F.col("w"), F.col("source").isNull(), "source")
    low = per.select(
        "w", full.alias("full"), F.row_number().over(by).alias("k"),
        F.coalesce(F.sum(full).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(W.partitionBy()).alias("all"))
    level = low.select("k", "w", "full", ((F.col("all") - F.col("before")) / F.col("rest")).alias("level"))
    level = level.where(F.col("level") * F.col("w") <= F.col("full")).agg(
        F.min_by("level", "k").alias("level"))
    return per.crossJoin(F.broadcast(level)).select(  # one row
        "source", "source_size", "n",
        F.least(full, F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _multipliers(cells: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """(source, lam, mean): the dual solution, lam in units of the source's mean size."""
    x = F.col("size") / F.col("mean")
    aim, least = F.col("target") / F.col("source_size"), F.col("least") / F.col("mean")
    now = (cells.where(F.col("size") > 0).groupBy("source").agg(F.min("size").alias("least"))
           .withColumnRenamed("source", "key")
           .join(sources, F.col("key").eqNullSafe(F.col("source"))).drop("key")
           .withColumn("mean", F.col("source_size") / F.col("n"))
           .select("source", "mean", "target", "source_size",
                   F.least(F.lit(0.0), F.log(aim) / least).alias("lo"),
                   F.greatest(F.lit(0.0), F.lit(math.log(limit)) / least).alias("hi"),
                   F.log(aim).alias("lam"), (aim >= limit * (1 - 1e-12)).alias("over")))
    now = written(now.withColumn("lam", F.when(F.col("over"), F.col("hi")).otherwise(F.col("lam"))),
                  "mix-dual")
    for _ in range(STEPS):
        each = cells.select(F.col("source").alias("key"), "size", "docs")
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("lam") * x, F.lit(700.0))))
        got = (each.join(now, F.col("key").eqNullSafe(F.col("source")))
               .groupBy("source", "mean", "target", "source_size", "lo", "hi", "lam", "over")
               .agg(F.sum(F.col("docs") * F.col("size") * rate).alias("g"),
                    F.sum(F.when(rate < limit, F.col("docs") * F.col("size") * rate * x)
                          .otherwise(0.0)).alias("h")))
        miss = F.log(F.col("g") / F.col("target"))
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - miss * F.col("g") / F.col("h")
        now = got.select("source", "mean", "target", "source_size", "over", miss.alias("miss"),
                         lo.alias("lo"), hi.alias("hi"),
                         F.when(F.col("over") | (F.abs(miss) <= TOLERANCE), F.col("lam"))
                         .when((F.col("h") > 0) & (step > lo) & (step < hi), step)
                         .otherwise((lo + hi) / 2).alias("lam"))
        now = written(now, "mix-dual")
        open_ = now.where(~F.col("over") & (F.abs("miss") > TOLERANCE)
                          & (F.col("hi") - F.col("lo") > 1e-14 * F.abs("lam")))
        if open_.isEmpty():
            break
        now = now.drop("miss")
    return now.select("source", "lam", "mean")


def _copies(limit: int):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "__place"], ascending=[False, True], kind="stable")
        due = taken = 0.0
        out = np.zeros(len(pdf), np.int64)
        for k, (size, rate) in enumerate(zip(pdf["size"].tolist(), pdf["rate"].tolist())):
            if size > 0:
                due += rate * size
                out[k] = min(limit, max(0, math.floor((due - taken) / size + 0.5)))
                taken += out[k] * size
        return pdf.assign(copies=out)[["__file", "__row", "copies"]]

    return fill


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
          size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
          limit: int = LIMIT) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and the
    place of the row (``__file``, ``__row``)."""
    rows = row_keyed(docs)
    n = F.size(words(F.col(text))).cast("long") if size is None else size
    held = written(rows.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                               n.alias("size"), "__file", "__row"), "mix-sizes")
    sources = written(targets(held, weights, limit), "mix-targets")
    cells = written(held.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-cells")
    dual = _multipliers(cells, sources, limit)
    told = sources.join(dual.withColumnRenamed("source", "key"),
                        F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
    told = written(told.withColumnRenamed("source", "key"), "mix-told")
    rate = F.least(F.lit(float(limit)),
                   F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))))
    place = F.xxhash64("doc_id", "__row")
    full = held.join(told, F.col("source").eqNullSafe(F.col("key"))).select(
        "source", "doc_id", "size", "source_size", "target", "__file", "__row",
        F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"), place.alias("__place"),
        F.pmod(place, F.ceil(F.col("n") / BUCKET)).alias("__bucket"))
    full = written(full, "mix-rates")
    kinds = T.StructType([full.schema["__file"], full.schema["__row"], T.StructField("copies", T.LongType())])
    copies = (full.select("source", "__bucket", "size", "rate", "__place", "__file", "__row")
              .groupBy("source", "__bucket").applyInPandas(_copies(limit), kinds))
    return full.drop("__place", "__bucket", "source").join(copies, ["__file", "__row"]).select(
        "doc_id", "size", "source_size", "target", "rate", "copies", "__file", "__row")


def mixture(docs: DataFrame, source: str = "source", doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns it came with."""
    inner, name = own_names(docs)
    rows = row_keyed(inner)
    copies = mixed(inner, name[source], name[doc_id], name[text]).where(F.col("copies") > 0).select(
        "__file", "__row", F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("__times"))
    taken = rows.join(copies, ["__file", "__row"])
    return restored(taken.select("*", F.explode("__times").alias("__k")), docs)
