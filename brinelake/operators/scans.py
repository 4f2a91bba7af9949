"""Ordered work along a stream of lines: carry-forward and runs (W1, W2), latest, top n.

A window over a whole stream would put the stream's history into one task, and one instrument
may well own a third of all rows.  Ordered results are therefore computed in two levels: inside
chunks of bounded size (a file split, a day, a span of line numbers), and over one summary row
per chunk; the summary is then joined back to its chunk.  Results are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelake.session import fresh_folder

# Lines per chunk where lines are numbered within a stream.
CHUNK_LINES = 1 << 18

# Lines and bytes per stored part of a binary blob.
PART_LINES, PART_BYTES = 4096, 1 << 22


def line_chunk(line_no: str = "line_no", size: int = CHUNK_LINES) -> Column:
    return F.floor(F.col(line_no) / size)


def _keyed(df: DataFrame, stream: list[str]) -> tuple[DataFrame, list[str]]:
    """Stream columns as text keys without NULLs, so that plain equality joins them back."""
    names = [f"_k{i}" for i in range(len(stream))]
    return df.withColumns({
        n: F.coalesce(F.col(s).cast("string"), F.lit("\0")) for n, s in zip(names, stream, strict=True)
    }), names


def _windows(keys: list[str], chunk: list[str], order: list[str]):
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    return inside, before


def carry_forward(
    df: DataFrame, values: dict[str, Column], stream: list[str], chunk: list[str], order: list[str],
) -> DataFrame:
    """Last non-null value so far along the stream, the current row included.

    ``values`` names the new columns; their expressions are NULL where nothing new starts.
    """
    keyed, keys = _keyed(df, stream)
    inside, before = _windows(keys, chunk, order)
    keyed = keyed.withColumns({f"_new_{n}": e for n, e in values.items()})
    local = keyed.withColumns({n: F.last(f"_new_{n}", ignorenulls=True).over(inside) for n in values})
    summary = keyed.groupBy(*keys, *chunk).agg(*[
        F.max_by(f"_new_{n}", F.when(F.col(f"_new_{n}").isNotNull(), F.struct(*order)))
        .alias(f"_end_{n}") for n in values])
    carried = summary.select(*keys, *chunk, *[
        F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in values])
    joined = local.join(carried, [*keys, *chunk], "left")
    return joined.select(*df.columns, *[
        F.coalesce(F.col(n), F.col(f"_in_{n}")).alias(n) for n in values])


def running_sum(
    df: DataFrame, values: dict[str, Column], stream: list[str], chunk: list[str], order: list[str],
) -> DataFrame:
    """Running totals along the stream, the current row included."""
    keyed, keys = _keyed(df, stream)
    inside, before = _windows(keys, chunk, order)
    local = keyed.withColumns({n: F.sum(e).over(inside) for n, e in values.items()})
    summary = keyed.groupBy(*keys, *chunk).agg(*[
        F.sum(e).alias(f"_end_{n}") for n, e in values.items()])
    carried = summary.select(*keys, *chunk, *[
        F.sum(f"_end_{n}").over(before).alias(f"_in_{n}") for n in values])
    joined = local.join(carried, [*keys, *chunk], "left")
    return joined.select(*df.columns, *[
        (F.col(n) + F.coalesce(F.col(f"_in_{n}"), F.lit(0))).alias(n) for n in values])


# Sentence types of the averaged formats: the header carries date and time for the others.
HEADER_TYPES = ("PNORH3", "PNORH4")
CARRIED_TYPES = ("PNORS3", "PNORS4", "PNORC3", "PNORC4")
CARRIED_CELLS = ("PNORC3", "PNORC4")


def attach_headers(
    parsed: DataFrame, stream: list[str], chunk: list[str], order: list[str],
    record_type: str = "record_type", ok: Column | None = None,
    date: Column | None = None, time: Column | None = None, status: Column | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Date, time and status of the last header before each line of its burst.

    Adds ``carried_date``, ``carried_time``, ``carried_status`` (NULL before the first header)
    and ``cell_index``, the number of the averaged cell in arrival order after its header.
    The default columns are those of ``parse_lines``.  ``initial`` continues earlier data: per
    stream the header in force (``carried_*``) and ``cells_since_header``, the form that
    ``header_state`` returns.
    """
    ok = F.col("parse_status") == "OK" if ok is None else ok
    date = F.get("vals", F.lit(0)) if date is None else date
    time = F.get("vals", F.lit(1)) if time is None else time
    status = F.get("vals", F.lit(3)) if status is None else status
    header = F.col(record_type).isin(*HEADER_TYPES) & ok
    cell = F.coalesce(F.col(record_type).isin(*CARRIED_CELLS) & ok, F.lit(False))
    keyed, keys = _keyed(parsed, stream)
    inside, before = _windows(keys, chunk, order)
    local = keyed.withColumn("_n", F.sum(cell.cast("bigint")).over(inside))
    local = local.withColumn("_start", F.when(header, F.struct(
        date.alias("d"), time.alias("t"), status.alias("s"), F.col("_n").alias("n"))))
    local = local.withColumn("_head", F.last("_start", ignorenulls=True).over(inside))
    # Per chunk: its averaged cells, and its last header with the cells counted up to it.
    summary = local.groupBy(*keys, *chunk).agg(
        F.max("_n").alias("_total"),
        F.max_by("_start", F.when(F.col("_start").isNotNull(), F.struct(*order))).alias("_end"))
    summary = summary.withColumn("_n0", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    ended = F.when(F.col("_end").isNotNull(), F.struct(
        F.col("_end.d").alias("d"), F.col("_end.t").alias("t"), F.col("_end.s").alias("s"),
        (F.col("_n0") + F.col("_end.n")).alias("n")))
    carried = summary.withColumn("_end", ended).select(
        *keys, *chunk, "_n0", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    if initial is not None:  # joined to the chunks, not to the rows
        start, _ = _keyed(initial, stream)
        carried = carried.join(start.select(*keys, F.struct(
            F.col("carried_date").alias("d"), F.col("carried_time").alias("t"),
            F.col("carried_status").alias("s"),
            (-F.col("cells_since_header").cast("bigint")).alias("n")).alias("_init")), keys, "left")
        carried = carried.withColumn("_in", F.coalesce("_in", "_init")).drop("_init")
    out = local.join(carried, [*keys, *chunk], "left")
    own = F.col("_head").isNotNull()
    pick = lambda f: F.when(own, F.col(f"_head.{f}")).otherwise(F.col(f"_in.{f}"))
    number = F.when(own, F.col("_n") - F.col("_head.n")).otherwise(
        F.col("_n0") + F.col("_n") - F.coalesce(F.col("_in.n"), F.lit(0)))
    return out.select(
        *parsed.columns,
        pick("d").alias("carried_date"), pick("t").alias("carried_time"),
        pick("s").alias("carried_status"),
        number.cast("int").alias("cells_since_header"),
        F.when(cell, number.cast("int")).alias("cell_index"))


def header_state(attached: DataFrame, stream: list[str], chunk: list[str], order: list[str],
                 initial: DataFrame | None = None) -> DataFrame:
    """Header in force at the end of every stream, to continue from."""
    fields = ("carried_date", "carried_time", "carried_status", "cells_since_header")
    last = attached.groupBy(*stream).agg(
        F.max_by(F.struct(*fields), F.struct(*chunk, *order)).alias("_l")).select(*stream, "_l.*")
    if initial is None:
        return last
    return last.unionByName(initial.select(*stream, *fields).join(
        last.select(*stream), stream, "left_anti"))


def number_runs(
    df: DataFrame, member: Column, stream: list[str], chunk: list[str], order: list[str],
) -> DataFrame:
    """``run_no`` counts the rows outside runs so far, so members of one run share it."""
    outside = (~F.coalesce(member, F.lit(False))).cast("bigint")
    return running_sum(df, {"run_no": outside}, stream, chunk, order)


def blob_parts(
    lines: DataFrame, payload: str, member: Column, stream: list[str], chunk: list[str],
    order: list[str], part_lines: int = PART_LINES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The bytes of each run of binary lines, in parts of bounded size.

    A run can be as long as the log, so it is never gathered whole: parts of at most
    ``part_lines`` lines and ``part_bytes`` bytes (or one longer line) within a chunk concatenate to
    the run in order of chunk and ``part_no``, the place in the chunk at which a part begins.
    """
    runs = number_runs(lines, member, stream, chunk, order).where(member)
    inside = Window.partitionBy(*stream, *chunk).orderBy(*order)
    runs = runs.withColumn("_pos", F.row_number().over(inside))
    so_far = F.sum(F.octet_length(F.col(payload).cast("binary"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_part", F.struct(F.floor((F.col("_pos") - 1) / part_lines).alias("l"),
                                             F.floor((so_far - 1) / part_bytes).alias("b")))
    has_time = "received_at" in lines.columns
    grouped = runs.groupBy(*stream, "run_no", *chunk, "_part").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(payload).cast("binary").alias("b"))))
        .alias("_rows"),
        F.count(F.lit(1)).alias("line_count"), (F.min("_pos") - 1).alias("_first"),
        *([F.min("received_at").alias("started_at")] if has_time else []))
    # Hex text joins in linear time; unhex gives the bytes back.
    data = F.unhex(F.array_join(F.transform("_rows", lambda r: F.hex(r["b"])), ""))
    return grouped.select(
        *stream, "run_no", *chunk, F.col("_first").cast("long").alias("part_no"), "line_count",
        *(["started_at"] if has_time else []), data.alias("payload"),
        F.length(data).alias("byte_count"))


def blob_index(
    lines: DataFrame, payload: str, member: Column, stream: list[str], chunk: list[str],
    order: list[str],
) -> DataFrame:
    """One row per run with its first position, line and byte count."""
    runs = number_runs(lines, member, stream, chunk, order).where(member)
    aggs = [F.count(F.lit(1)).alias("line_count"),
            F.sum(F.octet_length(F.col(payload))).alias("byte_count"),
            F.min(F.struct(*chunk, *order)).alias("first_position")]
    if "received_at" in lines.columns:
        aggs.append(F.min("received_at").alias("started_at"))
    return runs.groupBy(*stream, "run_no").agg(*aggs)


def latest_burst(df: DataFrame, ts: str = "measured_at", per_stream: bool = False) -> DataFrame:
    """All rows of the newest burst, or of the newest burst of every stream; an aggregate
    finds the times, no window is needed."""
    if per_stream:
        newest = df.groupBy(F.col("stream_id").alias("_s")).agg(F.max(ts).alias("_t"))
        return df.join(newest, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col(ts) == F.col("_t")),
                       "left_semi")
    newest = df.agg(F.max(ts).alias("t")).scalar()
    return df.where(F.col(ts) == newest)


def first_per_group(df: DataFrame, group: list[str], n: int, by: str = "received_at",
                    tie: str = "record_id") -> DataFrame:
    """The newest n rows per group.

    Each task keeps n rows per group before the shuffle (window group limit), so few groups
    with very many rows are no burden.
    """
    w = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def dealt_ranges(
    left: DataFrame, right: DataFrame, stream: list[str], left_ts: str, right_ts: str,
    values: list[str], tie: str | None = None, parts: int | None = None,
) -> DataFrame:
    """Both sides of an as-of join in ranges of (stream, time), ``_chunk``, by sampled splitters.

    A stream that has most of the rows, or all of a day's, is spread over as many ranges as its
    rows fill. The rows are written once, since every use has to see the same ranges.
    """
    spark = left.sparkSession
    order = F.struct(*values) if tie is None else F.struct(tie, *values)
    r = right.groupBy(*stream, F.col(right_ts).alias("_ts")).agg(
        F.max(order).alias("_v")).select(
        *stream, "_ts", F.lit(0).alias("_side"),
        F.struct(*[F.col(f"_v.{v}").alias(v) for v in values]).alias("_known"))
    value_type = r.schema["_known"].dataType
    l = left.select(*stream, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
                    F.lit(None).cast(value_type).alias("_known"), F.struct(*left.columns).alias("_row"))
    both = l.unionByName(r, allowMissingColumns=True)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.coalesce(F.col(s).cast("string"), F.lit("\0")) for s in stream]
    path = fresh_folder(spark, "as-of")
    dealt = both.repartitionByRange(n, *key, "_ts", "_side", F.xxhash64("_row")).withColumn(
        "_chunk", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def as_of_join(
    left: DataFrame, right: DataFrame, stream: list[str], left_ts: str, right_ts: str,
    values: list[str], tie: str | None = None, parts: int | None = None,
) -> DataFrame:
    """Last known ``values`` of ``right`` at or before each left row, per stream (for D6).

    What is carried on from one range to the next is one row per range and stream.
    """
    dealt = dealt_ranges(left, right, stream, left_ts, right_ts, values, tie, parts)
    done = carry_forward(dealt, {"_last": F.col("_known")}, stream, ["_chunk"], ["_ts", "_side"])
    return done.where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
