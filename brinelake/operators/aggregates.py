"""Aggregations (G1-G16).  All combine within each task before they shuffle."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelake.operators import filters

# Fixed value: buckets are counted from 2000-01-03 00:00:00.
BUCKET_ORIGIN = 946_857_600

def day_start(ts: str) -> Column:
    """Midnight of a zone-less time, without a detour over the session's zone."""
    return F.to_date(F.col(ts)).cast("timestamp_ntz")


def hour_start(ts: str) -> Column:
    return day_start(ts) + F.make_dt_interval(F.lit(0), F.hour(F.col(ts)))


AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def bucket(ts: str, minutes: int) -> Column:
    """Time window of a bucket, aligned to the fixed origin."""
    offset = BUCKET_ORIGIN % (minutes * 60)
    return F.window(F.col(ts), f"{minutes} minutes", startTime=f"{offset} seconds")


def time_buckets(
    df: DataFrame, column: str, minutes: int = 5, aggregation: str = "avg",
    time_range: str | None = None, as_of: datetime | None = None, ts: str = "received_at",
) -> DataFrame:
    """G1: one column aggregated per time bucket, in time order; unknown names mean avg."""
    if time_range:
        df = filters.look_back(df, time_range, as_of, ts)
    fn = AGGREGATES.get(aggregation.lower(), F.avg)
    value = F.col(column) if fn in (F.count, F.min, F.max) else F.col(column).cast("double")
    out = df.where(F.col(ts).isNotNull()).groupBy(bucket(ts, minutes).alias("w")).agg(
        fn(value).alias("value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "value").orderBy("bucket")


def column_stats(df: DataFrame, columns: list[str], deviation: bool = False) -> DataFrame:
    """A row per column with min, max, avg and count of its values, in one pass."""
    measures = {"min": F.min, "max": F.max, "avg": F.avg, "count": F.count}
    if deviation:
        measures["stddev"] = F.stddev_samp
    aggs, rows = [], []
    for i, name in enumerate(columns):
        c = F.col(name).cast("double")
        aggs += [fn(c).alias(f"c{i}_{m}") for m, fn in measures.items()]
        rows.append(F.struct(F.lit(name).alias("column_name"), *[
            F.col(f"c{i}_{m}").alias(f"{m}_val" if m != "count" else "count") for m in measures]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, width: float = 10.0) -> DataFrame:
    """Rows per bin of fixed width."""
    lower = F.floor(F.col(column).cast("double") / width).cast("double") * width
    return df.where(F.col(column).isNotNull()).groupBy(lower.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")).orderBy("bin")


def per_period(df: DataFrame, columns: list[str], period: str = "hour", ts: str = "received_at",
               with_count: bool = False) -> DataFrame:
    """Averages per hour or day; the day comes as a date."""
    if period not in ("hour", "day"):
        raise ValueError(f"unknown period {period!r}")
    start = F.to_date(F.col(ts)) if period == "day" else hour_start(ts)
    aggs = [F.count(F.lit(1)).alias("records")] if with_count else []
    aggs += [F.avg(F.col(c).cast("double")).alias(f"avg_{c}") for c in columns]
    return df.groupBy(start.alias(period)).agg(*aggs).orderBy(period)


def per_cell(df: DataFrame, columns: list[str], cell: str = "cell_index") -> DataFrame:
    """Mean velocity per depth cell."""
    return df.groupBy(cell).agg(
        F.count(F.lit(1)).alias("measurements"),
        *[F.avg(F.col(c).cast("double")).alias(f"avg_{c}") for c in columns]).orderBy(cell)


def counts(df: DataFrame, *by: str | Column, name: str = "count") -> DataFrame:
    """Rows per group, most frequent first."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.col(name).desc(), *[F.col(c).asc_nulls_last() for c in out.columns[:-1]])


def error_frequency(errors: DataFrame, ts: str = "received_at") -> DataFrame:
    """Errors per type with first and last time."""
    return errors.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("count"), F.min(ts).alias("first_occurrence"),
        F.max(ts).alias("last_occurrence")).orderBy(F.col("count").desc(), "error_type")


def errors_per_hour(errors: DataFrame, ts: str = "received_at") -> DataFrame:
    """G10."""
    return errors.groupBy(hour_start(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("error_count")).orderBy("hour")


def daily_log_stats(raw: DataFrame, instrument: str = "head_id", by: str = "record_type",
                    ts: str = "received_at", approximate: bool = False) -> DataFrame:
    """Per day and type, rows, instruments, valid and invalid checksums.

    ``approximate`` trades the exact instrument count, which needs a second shuffle, for a
    sketch.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return raw.groupBy(
        day_start(ts).alias("day"), F.col(by)).agg(
        F.count(F.lit(1)).alias("record_count"),
        distinct(F.col(instrument)).alias("instrument_count"),
        F.count_if(F.col("checksum_valid")).alias("valid_count"),
        F.count_if(~F.col("checksum_valid")).alias("invalid_count"))


def distinct_sketches(df: DataFrame, by: list[str], columns: list[str], ts: str = "received_at",
                      lg_k: int = 12) -> DataFrame:
    """Per day and group, rows and a mergeable sketch of the distinct values of each column.

    A sketch has a bounded size (some 2**lg_k bytes) whatever it has seen. Kept per day, as a table
    beside the log, any period is answered from the sketches of its days.
    """
    return df.groupBy(day_start(ts).alias("day"), *by).agg(F.count(F.lit(1)).alias("record_count"), *[
        F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"sketch_{c}") for c in columns])


def distinct_counts(sketches: DataFrame, by: list[str], columns: list[str], start: datetime | None = None,
                    end: datetime | None = None) -> DataFrame:
    """Rows and distinct values per group over the days of a period, from their sketches.

    The relative standard error is about 1.04 / sqrt(2**lg_k), 1.6 % at the default; ``count_distinct``
    over the rows is the exact form.
    """
    rows = filters.time_window(sketches, start, end, "day")
    return rows.groupBy(*by).agg(F.sum("record_count").alias("record_count"), *[
        F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"distinct_{c}") for c in columns])


def instrument_stats(df: DataFrame, by: tuple[str, ...] = ("instrument_type_name", "head_id"),
                     ts: str = "received_at") -> DataFrame:
    """Per instrument, rows, first and last time, mean temperature, pressure range."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.avg(F.col("temperature").cast("double")).alias("avg_temperature"),
        F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, tables without rows included."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def mean_amplitude() -> Column:
    """Mean of the four beams, a silent beam counting as 0."""
    beams = [F.coalesce(F.col(f"amp{i}").cast("double"), F.lit(0.0)) for i in (1, 2, 3, 4)]
    return (beams[0] + beams[1] + beams[2] + beams[3]) / 4.0


def of_stream(df: DataFrame) -> list[str]:
    """The column that tells instruments apart, where a frame has it: part of every burst's key."""
    return ["stream_id"] if "stream_id" in df.columns else []


def amplitude_cells(df: DataFrame, time_range: str | None = None, as_of: datetime | None = None,
                    ts: str = "received_at") -> DataFrame:
    """G14, long form: mean amplitude per stream, time and cell, all rows, no group ever collected."""
    if time_range:
        df = filters.look_back(df, time_range, as_of, ts)
    return df.select(*of_stream(df), ts, "cell_index", mean_amplitude().alias("avg_amp"))


def amplitude_heatmap(
    df: DataFrame, times: int | None, time_range: str | None = None, as_of: datetime | None = None,
    ts: str = "received_at", tie: str = "record_id",
) -> DataFrame:
    """One array of amplitudes per stream and time, by cell, newest time first.

    ``times`` keeps that many of the newest times of every stream, each with all its cells; None
    keeps all.
    """
    if time_range:
        df = filters.look_back(df, time_range, as_of, ts)
    stream = of_stream(df)
    rows = df.select(*stream, ts, "cell_index", mean_amplitude().alias("avg_amp"), tie)
    if times is not None:
        each = rows.select(*stream, ts).distinct()
        last = F.col(ts).desc_nulls_last()
        if stream:  # a task keeps so many times of a stream before the shuffle (window group limit)
            rank = F.row_number().over(Window.partitionBy(*stream).orderBy(last))
            newest = each.withColumn("_rank", rank).where(F.col("_rank") <= times).drop("_rank")
        else:
            newest = each.orderBy(last).limit(times)
        newest = newest.toDF(*[f"_n{k}" for k in range(len(stream) + 1)])
        same = [F.col(c).eqNullSafe(F.col(f"_n{k}")) for k, c in enumerate([*stream, ts])]
        rows = rows.join(newest, reduce(lambda x, y: x & y, same), "left_semi")
    grouped = rows.groupBy(*stream, ts).agg(F.sort_array(F.collect_list(
        F.struct("cell_index", tie, "avg_amp"))).alias("cells"))
    return grouped.select(*stream, ts, F.transform("cells", lambda c: c["avg_amp"]).alias("amplitudes")
                          ).orderBy(F.col(ts).desc_nulls_last(), *stream)


def profile_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean per velocity component, missing values ignored."""
    return df.agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns])


def latest_times(tables: dict[str, DataFrame], ts: str = "received_at") -> DataFrame:
    """Newest record time per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.max(ts).alias("latest")).select(F.lit(name).alias("table_name"), "latest")
        out = part if out is None else out.unionByName(part)
    return out


def latest_row(df: DataFrame, columns: list[str], ts: str = "received_at",
               tie: str = "record_id") -> DataFrame:
    """Chosen columns of the newest row."""
    newest = F.max_by(F.struct(*columns), F.struct(ts, tie))
    return df.where(F.col(ts).isNotNull()).agg(newest.alias("r")).select("r.*")
