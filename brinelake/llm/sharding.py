"""Shards of near-equal size by sampled splitters.

Rows are ordered by the hash of their text, so that equal texts stand together, and then by their
id and place. A sample in which a row counts by its size gives quantiles of that order: the
splitters of many small ranges. All rows are counted against them. A range that is overfull is
subdivided by a sample of its own rows: between texts first, and where one text alone is too much,
between its copies; this goes on until no range is overfull that has two different keys.
Consecutive ranges then make up the shards, cut where the running size comes nearest to equal
parts, and every range knows its shard and how many rows stand before it there. The rows are
shuffled once, in pieces of shards, and written in order.

What is gathered is bounded by parameters: at most ``RANGES`` ranges (and as many again while they
are subdivided), ``DRAWS`` drawn rows for each, 24 bytes each. Every task gets the splitters.

The files hold ``shard``, ``slot`` (place in the shard from 0, without gaps) and ``row``, a struct
with the columns of the table, which therefore cannot clash with anything.

Defined cases: null text has no bytes and a size of 1, as the empty one; null ids are ids like
others; repeated rows are rows of their own; a row larger than a shard's part is not cut, so shards
can differ by what their largest rows leave no choice about; a copy group stays in one shard
unless it is larger than two ranges; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.common import own_names, row_keyed, written

#: Ranges per shard, bytes of a range, ranges in all at most.
FINE, RANGE_BYTES, RANGES = 64, 64 << 20, 1 << 16
#: Rows drawn per wanted range, on average.
DRAWS = 8
#: Bytes of the pieces of a shard that are written by one task each.
PIECE_BYTES = 64 << 20
_LOW = np.iinfo(np.int64).min


def _keys(h: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Sixteen bytes that sort as the pair of signed numbers does."""
    both = np.empty((len(h), 2), ">u8")
    both[:, 0] = h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = tie.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.reshape(-1).view("S16")


def _uniform(h: np.ndarray, tie: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) per row, the same in every run."""
    x = h.view(np.uint64) ^ (tie.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(turn * 0x632BE59B)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _numpy(*columns: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in columns]


def _range_of(splitters: np.ndarray) -> Column:
    """Number of the range that the key (h, tie) lies in."""

    @F.arrow_udf(T.IntegerType())
    def number(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, tie in batches:
            yield pa.array(np.searchsorted(splitters, _keys(*_numpy(h, tie)), "right").astype(np.int32))

    return number("h", "tie")


def _drawn(splitters: np.ndarray, unit: np.ndarray, turn: int) -> Column:
    """Weight of a row in the sample, null if it is not drawn: a row as large as the unit of its
    range always is and counts by its size; a smaller one is with the probability of its part."""

    @F.arrow_udf(T.DoubleType())
    def weight(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            h, tie, size = _numpy(*batch)
            of = unit[np.searchsorted(splitters, _keys(h, tie), "right")]
            with np.errstate(divide="ignore"):
                drawn = _uniform(h, tie, turn) < np.where(of > 0, size / of, 0)
            yield pa.array(np.maximum(size, of), mask=~drawn)

    return weight("h", "tie", "size")


def _cuts(h: np.ndarray, tie: np.ndarray, weight: np.ndarray, parts: int, one_text: bool) -> np.ndarray:
    """Splitters (h, tie) at the quantiles of a sample, in pairs of rows."""
    order = np.lexsort((tie, h))
    h, tie, weight = h[order], tie[order], weight[order]
    ends = np.cumsum(weight)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    if one_text:
        return np.stack([h[at], tie[at]], 1)
    picks = h[at]
    twice = np.unique(picks[1:][picks[1:] == picks[:-1]])  # a text of over one part: cut after it as well
    after = twice[twice < np.iinfo(np.int64).max] + 1
    cuts = np.concatenate([picks, after])
    return np.stack([cuts, np.full(len(cuts), _LOW)], 1)


def ranges(keys: DataFrame, shards: int, fine: int = FINE, range_bytes: int = RANGE_BYTES,
           most: int = RANGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters, and size and rows of every range, of a written table (h, tie, size)."""
    splitters = np.empty(0, "S16")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = int(min(most, max(shards * fine, total // range_bytes)))
    aim, turn = total / wanted, 0
    while True:
        n = len(splitters) + 1
        told = (keys.groupBy(_range_of(splitters).alias("r"))
                .agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("tie"), F.max("tie")).collect())
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        unit, parts, one_text = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        for r, s, k, h0, h1, t0, t1 in told:
            size[r], rows[r], one_text[r] = s, k, h0 == h1
            if s > 2 * aim and (h0, t0) != (h1, t1):
                parts[r] = -(-s // max(1, int(aim)))
                unit[r] = s / (parts[r] * DRAWS)
        if not parts.any():
            return splitters, size, rows
        sample = (keys.withColumn("w", _drawn(splitters, unit, turn)).where(F.col("w").isNotNull())
                  .select(_range_of(splitters).alias("r"), "h", "tie", "w").toArrow())
        r, h, tie, w = _numpy(*(c.combine_chunks() for c in sample.columns))
        order = np.argsort(r, kind="stable")
        r, h, tie, w = r[order], h[order], tie[order], w[order]
        new = [np.empty((0, 2), np.int64)]
        for k in np.flatnonzero(parts).tolist():
            a, b = np.searchsorted(r, [k, k + 1])
            if b > a:
                new.append(_cuts(h[a:b], tie[a:b], w[a:b], int(parts[k]), bool(one_text[k])))
        found = np.concatenate(new)
        grown = np.union1d(splitters, _keys(found[:, 0], found[:, 1]))
        if len(grown) == len(splitters) and turn >= 8:  # rows that no sample can part any more
            return splitters, size, rows
        splitters, turn = grown, turn + 1


def shard_plan(size: np.ndarray, rows: np.ndarray, shards: int,
               piece_bytes: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per range: its shard, the piece of the shard it is written with, the rows before it there."""
    ends = np.cumsum(size)
    total = int(ends[-1])
    cut = [0]
    for k in range(1, shards):
        aim = total * k / shards
        j = int(np.searchsorted(ends, aim))  # ranges before j end below the aim
        below = int(ends[j - 1]) if j else 0
        j += j < len(ends) and ends[j] - aim < aim - below
        cut.append(max(cut[-1], j))
    cut.append(len(size))
    shard = np.repeat(np.arange(shards), np.diff(cut)).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(rows)[:-1]])
    first = np.concatenate([[0], ends[:-1]])
    starts = np.array([c for c in cut[:-1]]).clip(max=len(size) - 1)
    piece = ((first - first[starts[shard]]) // piece_bytes).astype(np.int32)
    return shard, piece, before - before[starts[shard]]


def placed(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
           **limits: int) -> DataFrame:
    """``docs`` as ``row``, with the ``shard``, ``piece``, ``range`` and key of each, and how many
    rows of the shard stand ``before`` the range."""
    inner, name = own_names(docs)
    body = F.col(name[text])
    rows = row_keyed(inner)
    keyed = rows.select(
        F.struct(*[F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)]).alias("row"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), F.xxhash64(F.col(name[doc_id]), "__row").alias("tie"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"))
    splitters, size, count = ranges(written(keyed.select("h", "tie", "size"), "shard-keys"), shards, **limits)
    shard, piece, before = shard_plan(size, count, shards)

    @F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("range", "shard", "piece")]).add("before", "long"))
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, tie in batches:
            at = np.searchsorted(splitters, _keys(*_numpy(h, tie)), "right")
            yield pa.StructArray.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(piece[at]), pa.array(before[at])],
                names=["range", "shard", "piece", "before"])

    return keyed.select("row", "h", "tie", F.inline(F.array(place("h", "tie"))))


def write(docs: DataFrame, folder: str, shards: int, doc_id: str = "doc_id", text: str = "text",
          **limits: int) -> None:
    """The rows of ``docs`` below ``folder/shard=...``, each file in order of its slots."""
    rows = placed(docs, shards, doc_id, text, **limits)
    inside = "row_number() OVER (PARTITION BY shard, piece, range ORDER BY h, tie)"
    (rows.repartition("shard", "piece")
     .select("shard", (F.col("before") + F.expr(inside) - 1).cast("long").alias("slot"), "row")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(folder))
    docs.sparkSession.createDataFrame([], T.StructType([T.StructField("row", docs.schema)])).write.mode(
        "overwrite").parquet(f"{folder}/_columns")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, slot, row) of written shards."""
    row = spark.read.parquet(f"{folder}/_columns").schema["row"].dataType
    schema = T.StructType().add("slot", "long").add("row", row).add("shard", T.IntegerType())
    return spark.read.schema(schema).parquet(folder).select("shard", "slot", "row")
