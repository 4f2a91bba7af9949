"""Audit of filters that are applied one after another, over every order of them.

What a filter removes depends on the filters before it. A document is only looked at once: which
filters it fails is a bit mask, and all documents of one part (source) with one mask are one cell
with three weights: documents, those of good quality, toxic ones. A cell is folded across the array
of all orders with ``aggregate`` and ``transform``: an order is walked step by step, the first
filter that the mask fails removes the cell there, and later ones find it gone. That gives a struct
per order and step (600 of five filters) with the cell's weights; the structs of a part's cells, at
most 32, are merged by elementwise sums.

Whether a text repeats one with a smaller id is told by 256-bit digests, from counts per digest and
part that are combined in each task before they are shuffled; no row is joined with its copies.

Defined cases: null text is empty; null source is the empty string, in one part with sources that
are empty strings; rows with equal ids and texts count one by one and do not repeat each other; a
null id is smaller or larger than none; documents without labels are neither good nor toxic, and
of several labels of one id any counts; an empty table gives no rows. No column is looked at but
the named ones, so others cannot clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.functions.barrier import with_once
from brinelake.llm.common import words, written

#: The filters in the order of their bits. A repeated text is not told from the text alone.
FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, w: Column) -> list[Column]:
    """For filters A to D, whether a text with the words ``w`` fails them."""
    n = F.size(w)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(w)) < 65 * n,
            100 * capitals.cast("long") > 5 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def marked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           source: str = "source") -> DataFrame:
    """(doc_id, digest, part, mask, n, good, toxic): documents by id and text, their failures of A
    to D, how often they occur, and whether they are labelled good or toxic."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("part"),
                     F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = with_once(df, w=words(F.col("t")))
    fails = text_failures(F.col("t"), F.col("w"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    df = with_once(df, digest=F.unhex(F.sha2("t", 256)), mask=mask.cast("int"))
    held = df.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.groupBy(F.col("doc_id").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return held.join(told, F.col("doc_id") == F.col("key"), "left").select(
        "doc_id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): weights per part and set of failed filters, E included.

    Copies of a text come together as one row per part and label; of these the smallest id's rows
    are the ones that repeat nothing.
    """
    each = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_none"))
    each = written(each, "audit-texts")
    first = each.groupBy("digest").agg(F.min("least").alias("first"))
    own = F.col("n_none") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    both = with_once(each.join(first, "digest"), own=own)
    split = F.array(F.struct(F.col("mask").alias("m"), F.col("own").alias("k")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(1 << REPEATED)).alias("m"),
                             (F.col("n") - F.col("own")).alias("k")))
    return (both.select("part", "good", "toxic", F.inline(split)).where(F.col("k") > 0)
            .groupBy("part", F.col("m").alias("mask"))
            .agg(F.sum("k").alias("n"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("toxic")))


def interactions(weights: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes, and would have removed.

    ``weights`` is the result of ``cells``; ``shapley`` sums what a filter removes over all orders.
    """
    orders = ["".join(p) for p in permutations(filters)]
    array = ", ".join("array({})".format(", ".join(str(filters.index(f)) for f in o)) for o in orders)
    named = ", ".join(f"0L AS {c}" for c in COUNTS)
    # One row of constants, sent to every task: 120 orders of five bits.
    told = weights.sparkSession.sql(f"SELECT array({array}) AS orders")
    here = weights.crossJoin(F.broadcast(told))
    folded = here.select("part", F.expr("""
        flatten(transform(orders, o -> aggregate(o,
          struct(true AS alive, cast(array() AS array<struct<kept: bigint, removed: bigint, redundant: bigint,
                 unique_fails: bigint, good_lost: bigint, toxic_lost: bigint>>) AS steps),
          (acc, f) -> transform(array(struct((mask & shiftleft(1, f)) <> 0 AS fails)), x -> struct(
            acc.alive AND NOT x.fails AS alive,
            concat(acc.steps, array(struct(
              if(acc.alive AND NOT x.fails, n, 0L) AS kept,
              if(acc.alive AND x.fails, n, 0L) AS removed,
              if(NOT acc.alive AND x.fails, n, 0L) AS redundant,
              if(mask = shiftleft(1, f), n, 0L) AS unique_fails,
              if(acc.alive AND x.fails, good, 0L) AS good_lost,
              if(acc.alive AND x.fails, toxic, 0L) AS toxic_lost))) AS steps))[0],
          acc -> acc.steps)))""").alias("cell"))
    sums = ", ".join(f"a.{c} + b.{c} AS {c}" for c in COUNTS)
    merged = folded.groupBy("part").agg(F.collect_list("cell").alias("cells")).select("part", F.expr(
        f"aggregate(cells, array_repeat(struct({named}), {len(orders) * len(filters)}),"
        f" (acc, x) -> zip_with(acc, x, (a, b) -> struct({sums})))").alias("steps"))
    n = len(filters)
    letter = "orders[cast({0} div %d AS int)][cast({0} %% %d AS int)]" % (n, n)
    merged = with_once(merged.crossJoin(F.broadcast(told)), shares=F.expr(
        f"transform(sequence(0, {n - 1}), f -> aggregate(zip_with(steps, sequence(0, size(steps) - 1),"
        f" (s, i) -> if({letter.format('i')} = f, s.removed, 0L)), 0L, (a, b) -> a + b))"))
    rows = merged.select("part", "shares", "orders", F.posexplode("steps").alias("i", "s"))
    order = F.get(F.array(*map(F.lit, orders)), F.expr(f"cast(i div {n} AS int)"))
    return rows.select("part", order.alias("filter_order"), F.expr(f"cast(i % {n} + 1 AS int)").alias("step"),
                       *[F.col(f"s.{c}").alias(c) for c in COUNTS],
                       F.expr(f"shares[{letter.format('i')}]").alias("shapley"))


def audited(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
            source: str = "source") -> DataFrame:
    """The audit of the five filters over documents and their labels."""
    return interactions(cells(marked(docs, labels, doc_id, text, source)))
