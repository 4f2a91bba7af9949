"""Structured Streaming forms."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from brinelake.functions import sentences as S
from brinelake.operators import aggregates, scans
from brinelake.plans import ingest as I
from brinelake.plans import parse
from brinelake.sources import generations as G
from brinelake.sources import lake
from brinelake.sources.lines import LINE_CHUNK, LINE_ORDER, number_lines


class LineIngest:
    """A line stream into the lake, batch by batch.

    What a batch has to know of earlier ones, the header in force and an unfinished blob per
    stream, is a small table written at the end of every batch under its id.  All work inside
    a batch is the distributed two-level scan of the batch form, so one busy stream is spread
    over many tasks.  Every output is written under the id of its batch and replaced if the
    batch runs again: after a restart nothing is lost and nothing doubled.
    """

    def __init__(self, base: str, strict: bool = False, assemble_blobs: bool = True,
                 split_blobs: bool = False,
                 clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)):
        self.base = base.rstrip("/")
        self.strict = strict
        self.assemble_blobs = assemble_blobs
        self.split_blobs = split_blobs  # end runs at batch edges: no blob state
        self.clock = clock  # what a batch takes for now when it counts its newest lines

    # ---------------------------------------------------------------- state between batches
    def _state_path(self, kind: str, batch_id: int) -> str:
        return f"{self.base}/_state/{kind}/batch_id={batch_id}"

    def _state(self, spark: SparkSession, kind: str, batch_id: int) -> DataFrame | None:
        """State after the batch before; None for the first batch."""
        return spark.read.parquet(self._state_path(kind, batch_id - 1)) if batch_id > 0 else None

    def _write(self, df: DataFrame, folder: str, batch_id: int) -> None:
        lake.write_run(df, self.base, folder, str(batch_id))

    # ------------------------------------------------------------------------------ batch
    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = f"{self.base}/_work/batch_id={batch_id}"
        now = F.lit(self.clock().isoformat(sep=" ")).cast("timestamp_ntz")
        told = Observation()  # R6: counted while lines are written and parsed, in no pass of their own
        lines = I.stage(number_lines(batch).observe(
            told, F.count(F.lit(1)).alias("lines"), F.max("received_at").cast("string").alias("newest"), *[
                F.count_if(F.col("received_at") > now - F.make_dt_interval(mins=F.lit(m))).alias(n)
                for n, m in (("last_minute", 1), ("last_5_minutes", 5))],
            F.count_if(I.is_blob_line(S.one_char_per_byte("raw_sentence"))).alias("blob_lines")), f"{work}/lines")
        blobs = None
        if self.assemble_blobs:
            lines, blobs = self._blobs(spark, lines, batch_id, told.get["blob_lines"] > 0)
        failed = Observation()
        parsed = I.stage(parse.parse_lines(lines, strict=self.strict).observe(
            failed, F.count_if(F.col("parse_status") == "FAIL").alias("errors")), f"{work}/parsed", by="table_name")
        _put(spark, f"{self.base}/_health/batches/{batch_id:012d}.json", {"batch_id": batch_id, **told.get, **failed.get})

        known = self._state(spark, "headers", batch_id)
        staged, averaged = I.dated(parsed, f"{work}/dated", blobs, known)
        if averaged is not None:
            state = scans.header_state(averaged, I.STREAM, LINE_CHUNK, LINE_ORDER, known)
        elif known is not None:
            state = known
        else:
            state = spark.createDataFrame([], "stream_id string, carried_date string, carried_time"
                                              " string, carried_status string, cells_since_header int")
        state.write.mode("overwrite").parquet(self._state_path("headers", batch_id))

        I.write_all(I.outputs(staged, I.present_tables(staged)), self.base, str(batch_id))
        if batch_id > 0:  # a batch begins only after the one before has committed
            lake.remove(spark, f"{self.base}/_work/batch_id={batch_id - 1}")
        for kind in ("headers", "blobs"):  # the state read above stays for a run of this batch again
            if batch_id > 1:
                lake.remove(spark, self._state_path(kind, batch_id - 2))

    def _blobs(self, spark: SparkSession, lines: DataFrame, batch_id: int, any_here: bool):
        """Blob parts under an id that a run keeps over batch edges."""
        rows = I.filled_lines(lines)
        member = I.is_blob_line()
        own_id = F.concat_ws("-", F.lit(str(batch_id)), F.col("run_no").cast("string"))
        open_runs = None if self.split_blobs else self._state(spark, "blobs", batch_id)
        if open_runs is None:
            open_runs = spark.createDataFrame([], "stream_id string, open_blob string")
        if not any_here and open_runs.isEmpty():
            open_runs.write.mode("overwrite").parquet(self._state_path("blobs", batch_id))
            return rows.drop("_text"), None
        started = F.col("run_no") == 0  # nothing outside a run came before it in this batch

        def named(df: DataFrame) -> DataFrame:
            joined = df.join(open_runs, "stream_id", "left")
            return joined.withColumn("blob_id", F.when(
                started & F.col("open_blob").isNotNull(), F.col("open_blob")).otherwise(own_id)
            ).withColumn("continues", started & F.col("open_blob").isNotNull()).drop("open_blob")

        parts = scans.blob_parts(rows, "raw_sentence", member, I.STREAM, LINE_CHUNK, LINE_ORDER)
        self._write(named(parts).withColumn("received_at", F.col("started_at")), "BLOBS", batch_id)
        index = named(scans.blob_index(rows, "raw_sentence", member, I.STREAM, LINE_CHUNK, LINE_ORDER))

        last = rows.groupBy("stream_id").agg(F.max_by(
            F.struct(member.alias("open")), F.struct(*LINE_CHUNK, *LINE_ORDER)).alias("_l"))
        end = index.groupBy("stream_id").agg(F.max_by("blob_id", "run_no").alias("open_blob"))
        now = last.where("_l.open").join(end, "stream_id").select("stream_id", "open_blob")
        kept = open_runs.join(last.select("stream_id"), "stream_id", "left_anti")
        now.unionByName(kept).write.mode("overwrite").parquet(
            self._state_path("blobs", batch_id))

        new = index.where(~F.col("continues")).withColumn("received_at", F.col("started_at"))
        return rows.where(~member).drop("_text"), I.blob_rows(new)

    def start(self, lines: DataFrame, checkpoint: str, available_now: bool = False,
              interval: str = "10 seconds") -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()


def live_buckets(stream: DataFrame, column: str, minutes: int = 5, aggregation: str = "avg",
                 ts: str = "received_at", delay: str = "10 minutes") -> DataFrame:
    """G1 on a stream.  Rows later than the watermark are dropped; that is our choice, the
    batch form keeps them.  Watermarks need times with a zone: zone-less ones are read in the
    session's zone, which should be UTC, and come back zone-less."""
    zoneless = dict(stream.dtypes)[ts] == "timestamp_ntz"
    if zoneless:
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    fn = aggregates.AGGREGATES.get(aggregation.lower(), F.avg)
    value = F.col(column) if fn in (F.count, F.min, F.max) else F.col(column).cast("double")
    out = stream.withWatermark(ts, delay).groupBy(
        aggregates.bucket(ts, minutes).alias("w")).agg(fn(value).alias("value"))
    start = F.col("w.start").cast("timestamp_ntz") if zoneless else F.col("w.start")
    return out.select(start.alias("bucket"), "value")


def completed(emitted: DataFrame, rows: DataFrame, column: str, minutes: int = 5,
              aggregation: str = "avg", ts: str = "received_at") -> DataFrame:
    """Emitted buckets and, from the rows themselves, those that the watermark still holds
    back. A stream that ends never closes its last buckets; the batch form does."""
    tail = aggregates.time_buckets(rows, column, minutes, aggregation, ts=ts)
    return emitted.unionByName(tail.select(*emitted.columns).join(emitted.select("bucket"), "bucket", "left_anti"))


def ingest_health(raw: DataFrame, errors: DataFrame, as_of: datetime,
                  ts: str = "received_at") -> DataFrame:
    """Rows in the last minute and 5 minutes, all rows, errors, age of the newest row."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")

    def since(minutes: int):
        edge = F.lit((as_of - timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.count_if(F.col(ts) > edge)

    lines = raw.agg(
        F.count(F.lit(1)).alias("total_lines"), since(1).alias("last_minute"),
        since(5).alias("last_5_minutes"), F.max(ts).alias("newest"))
    failed = errors.agg(F.count(F.lit(1)).alias("errors")).scalar()
    return lines.select(
        "total_lines", "last_minute", "last_5_minutes", failed.alias("error_count"), "newest",
        F.timestamp_diff("SECOND", F.col("newest"), now).alias("age_seconds"))


def _put(spark: SparkSession, path: str, row: dict) -> None:
    """One small row as a file; a repeated batch replaces its own."""
    files, where = G.store(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(json.dumps(row, default=str).encode()))
    finally:
        out.close()


class ProgressTable(StreamingQueryListener):
    """A listener that keeps what the engine reports of every batch as a table beside the lake."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/_health/progress"

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        _put(self.spark, f"{self.path}/{p.runId}-{p.batchId:012d}.json", {
            "query_id": str(p.id), "batch_id": p.batchId, "heartbeat": p.timestamp, "rows": p.numInputRows,
            "rows_per_second": p.processedRowsPerSecond})


def stream_health(spark: SparkSession, base: str, as_of: datetime) -> DataFrame:
    """Health of a stream, running or ended, from its tables: lines, those of the last minutes as
    its batches saw them, errors, age of the newest line and of the last heartbeat in seconds.

    Without a ``ProgressTable`` the heartbeat is unknown.
    """
    base = base.rstrip("/")
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    told = spark.read.schema("batch_id long, lines long, newest string, last_minute long, last_5_minutes long,"
                             " errors long").json(f"{base}/_health/batches")
    out = told.agg(F.sum("lines").alias("total_lines"), F.sum("last_minute").alias("last_minute"),
                   F.sum("last_5_minutes").alias("last_5_minutes"), F.sum("errors").alias("error_count"),
                   F.max("newest").cast("timestamp_ntz").alias("newest"))
    beat = F.lit(None).cast("timestamp_ntz")
    if G.names(spark, f"{base}/_health/progress/*.json"):
        beats = spark.read.schema("heartbeat string").json(f"{base}/_health/progress")
        beat = beats.agg(F.max(F.to_timestamp_ntz("heartbeat", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))).alias("b")).scalar()
    return out.select(
        "total_lines", "last_minute", "last_5_minutes", "error_count", "newest",
        F.timestamp_diff("SECOND", F.col("newest"), now).alias("age_seconds"),
        F.timestamp_diff("SECOND", beat, now).alias("heartbeat_age_seconds"))


def progress(query: StreamingQuery) -> dict:
    """Rows and rates of the last batch, as the engine reports them."""
    last = query.lastProgress or {}
    return {k: last.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond",
                                     "processedRowsPerSecond", "timestamp")}
