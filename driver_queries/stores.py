"""Sources, sinks, lake, upgrade, metadata, SQL functions and streams.

Whatever these write is derived from the given tables and goes to a fresh folder below the
shared one; the query then reads it back.
"""

from __future__ import annotations

import time
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinelake.operators import filters as K
from brinelake.operators import metadata as C
from brinelake.operators import scans
from brinelake.plans import ingest as I
from brinelake.plans import parse as P
from brinelake.plans import upgrade as M
from brinelake.plans import views as V
from brinelake.session import fresh_folder
from brinelake.sources import generations as G
from brinelake.sources import lake, skipping
from brinelake.sources.bytelines import read_byte_lines
from brinelake.sources.lines import LINE_CHUNK, LINE_ORDER, number_lines, read_lines, stream_lines
from brinelake.streaming import live
from driver_queries.registry import query, rounded
from driver_queries.tabular import CARRIED_SQL

NOON = datetime(2024, 1, 15, 12)


def _line_files(f, text: str | None = None, by: str = "stream_id") -> str:
    """Lines as one text file per stream, in line order; returns the folder."""
    rows = f.sql(text) if text else f.lines
    path = fresh_folder(f.spark, "lines")
    rows.repartition(F.col(by)).sortWithinPartitions(by, "line_no").select(by, "raw_sentence").write.partitionBy(
        by).text(path)
    return path


def _stream_of():
    return F.regexp_extract("file_path", r"stream_id=([^/]+)", 1)


# ------------------------------------------------------------------------------ S: sources
@query("s01_read_lines", "lines", "SELECT CAST(stream_id AS VARCHAR) AS stream_id, raw_sentence, row_number() OVER"
       " (PARTITION BY stream_id ORDER BY line_no) AS line_in_block FROM lines")
def _(f):
    lines = number_lines(read_lines(f.spark, _line_files(f), _stream_of(), "*.txt"))
    return lines.select("stream_id", "raw_sentence", F.col("line_in_block").cast("bigint").alias("line_in_block"))


@query("s01_byte_lines", "lines", """SELECT CAST(stream_id AS VARCHAR) AS stream_id, hex(raw_sentence) || printf('%02X', CASE WHEN line_no % 256 = 10 THEN 255
 ELSE line_no % 256 END) AS code, true AS in_order FROM lines""")
def _(f):
    """Lines that end in any byte but a line feed, read in pieces of a few kilobytes; in_order: offsets follow the line numbers."""
    path = fresh_folder(f.spark, "bytes")
    end = F.unhex(F.lpad(F.hex(F.when(F.col("line_no") % 256 == 10, 255).otherwise(F.col("line_no") % 256)), 2, "0"))
    rows = f.lines.select("stream_id", "line_no", F.concat(F.col("raw_sentence").cast("binary"), end).cast("string").alias("value"))
    rows.repartition("stream_id").sortWithinPartitions("stream_id", "line_no").select("stream_id", "value").write.partitionBy(
        "stream_id").text(path)
    got = read_byte_lines(f.spark, path, piece=5000)
    got = got.withColumns({"stream_id": _stream_of(), "code": F.hex("line")})
    got = number_lines(got, "offset").withColumnRenamed("line_no", "k")
    known = f.lines.select(F.col("stream_id").cast("string").alias("stream_id"), "line_no", F.hex(F.col("raw_sentence").cast("binary")).alias("head"))
    known = scans.running_sum(known.withColumn("_chunk", scans.line_chunk()), {"k": F.lit(1).cast("bigint")},
                              ["stream_id"], ["_chunk"], ["line_no"]).drop("_chunk", "line_no")
    both = got.join(known, ["stream_id", "k"], "left")
    return both.select("stream_id", "code", F.coalesce(F.col("code").startswith(F.col("head")), F.lit(False)).alias("in_order"))


@query("s02_stream_lines", "lines", "SELECT CAST(stream_id AS VARCHAR) AS stream_id, count(*) AS n FROM lines GROUP BY 1")
def _(f):
    source = _line_files(f)
    out, state = fresh_folder(f.spark, "stream-out"), fresh_folder(f.spark, "stream-state")
    lines = stream_lines(f.spark, source, _stream_of(), 3, "*.txt")
    q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return f.spark.read.parquet(out).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))


def _lake(f) -> str:
    base = fresh_folder(f.spark, "lake")
    lake.write_lake(f.sensor, base, "PNORS", "overwrite")
    lake.write_lake(f.cells, base, "PNORC", "overwrite")
    return base


@query("s03_read_lake", "sensor cells", """SELECT 'PNORS' AS record_type, CAST(received_at AS DATE) AS day, count(*) AS n,
 round(sum(heading), 4) AS total FROM sensor WHERE CAST(received_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY 2
 UNION ALL SELECT 'PNORC', CAST(received_at AS DATE), count(*), round(sum(vel1), 4) FROM cells
 WHERE CAST(received_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY 2""")
def _(f):
    got = lake.read_lake(f.spark, _lake(f), ["PNORS", "PNORC", "PNORX"], date(2024, 1, 3), date(2024, 1, 12))
    out = None
    for name, value in (("PNORS", "heading"), ("PNORC", "vel1")):
        part = got[name].groupBy(F.col("date").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
            F.lit(name).alias("record_type"), "day", "n", "total")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query("s03_schema_drift", "sensor", """SELECT record_id, CASE WHEN record_id % 2 = 0 THEN CAST(floor(heading) AS DOUBLE) ELSE heading END AS heading,
 CASE WHEN record_id % 2 = 1 THEN pitch END AS pitch FROM sensor""")
def _(f):
    base = fresh_folder(f.spark, "drift")
    even = f.sensor.where("record_id % 2 = 0").select("record_id", F.floor("heading").cast("int").alias("heading"))
    odd = f.sensor.where("record_id % 2 = 1").select("record_id", "heading", "pitch")
    even.write.parquet(f"{base}/PNORS/date=2024-01-01")
    odd.write.parquet(f"{base}/PNORS/date=2024-01-02")
    return lake.read_type(f.spark, base, "PNORS").select("record_id", "heading", "pitch")


@query("s03_mixed_files", "sensor", """SELECT record_id, CASE WHEN record_id % 2 = 0 THEN CAST(floor(heading) AS DOUBLE) ELSE heading END AS heading,
 CASE WHEN record_id % 2 = 1 THEN pitch END AS pitch FROM sensor""")
def _(f):
    day = f"{fresh_folder(f.spark, 'mixed')}/PNORS/date=2024-01-01"
    even = f.sensor.where("record_id % 2 = 0").select("record_id", F.floor("heading").cast("int").alias("heading"))
    even.write.mode("append").parquet(day)
    f.sensor.where("record_id % 2 = 1").select("record_id", "heading", "pitch").write.mode("append").parquet(day)
    return lake.read_type(f.spark, day.rsplit("/", 2)[0], "PNORS").select("record_id", "heading", "pitch")


def _half_written(f) -> str:
    """A lake whose even rows are finished, each file with a leftover twin, and whose odd rows are not."""
    base = fresh_folder(f.spark, "unfinished")
    for run, rest in (("done", 0), ("open", 1)):
        lake.write_run(f.sensor.where(f"record_id % 2 = {rest}"), base, "PNORS", run)
    store, _ = G.store(f.spark, base)
    path = f.spark._jvm.org.apache.hadoop.fs.Path
    for row in lake.list_files(f.spark, base, "*.parquet").select("path").toLocalIterator():  # files, not rows
        late = path(row.path + ".writing")
        if "/batch_id=open/" in row.path:
            store.rename(path(row.path), late)
        else:
            out = store.create(late)
            out.writeByte(1)  # empty files are not listed
            out.close()
    return base


@query("s04_unfinished_files", "sensor", "SELECT record_id, heading FROM sensor WHERE record_id % 2 = 0")
def _(f):
    return lake.read_type(f.spark, _half_written(f), "PNORS").select("record_id", "heading")


@query("s05_chosen_views", "sensor cells", "SELECT count(*) AS n, count(DISTINCT CAST(received_at AS DATE)) AS days, 1 AS views FROM cells"
       " WHERE CAST(received_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def _(f):
    names = lake.register_lake_views(f.spark, _lake(f), "chosen_", types=["PNORC", "PNORX"], start=date(2024, 1, 5), end=date(2024, 1, 9))
    return C.run_sql(f.spark, f"SELECT count(*) AS n, count(DISTINCT date) AS days, {len(names)} AS views FROM chosen_pnorc")


@query("s05_lake_views", "sensor cells", "SELECT s.data_format, count(*) AS n FROM sensor s JOIN cells c"
       " ON s.received_at = c.received_at AND s.data_format = c.data_format GROUP BY 1")
def _(f):
    lake.register_lake_views(f.spark, _lake(f))
    return C.run_sql(f.spark, "SELECT s.data_format, count(*) AS n FROM view_pnors s JOIN view_pnorc c"
                     " ON s.received_at = c.received_at AND s.data_format = c.data_format GROUP BY s.data_format")


@query("s06_inventory", "sensor cells", """SELECT DISTINCT 'PNORS' AS record_type, CAST(received_at AS DATE) AS date FROM sensor
 UNION SELECT DISTINCT 'PNORC', CAST(received_at AS DATE) FROM cells""")
def _(f):
    return lake.lake_inventory(f.spark, _lake(f)).where("files > 0 AND bytes > 0").select("record_type", "date")


@query("s07_stale_writes", "sensor", """SELECT status, count(DISTINCT CAST(received_at AS DATE)) AS days FROM sensor
 CROSS JOIN (SELECT unnest(['completed', 'waiting_first_retry', 'waiting_second_retry', 'fault_detected']) AS status) s
 WHERE (status = 'completed') = (record_id % 2 = 0) GROUP BY 1""")
def _(f):
    base = _half_written(f)
    newest = lake.list_files(f.spark, base, lake.UNFINISHED).agg(F.max("modificationTime").alias("t")).first().t
    out = None
    for seconds, state in ((1, "waiting_first_retry"), (20, "waiting_second_retry"), (120, "fault_detected")):
        seen = lake.stale_writes(f.spark, base, datetime.fromtimestamp(newest.timestamp() + seconds))
        seen = seen.where(F.col("status").isin("completed", state))
        out = seen if out is None else out.unionByName(seen)
    return out.groupBy("status").agg(F.countDistinct(F.regexp_extract("path", r"/date=([^/]+)/", 1)).alias("days"))


# -------------------------------------------------------------------------------- A: sinks
@query("a01_append_raw", "raw", "SELECT line_id, raw_sentence, parse_status FROM raw")
def _(f):
    path = fresh_folder(f.spark, "raw")
    lake.append_rows(f.raw.where("line_id % 2 = 0"), path)
    lake.append_rows(f.raw.where("line_id % 2 = 1"), path)
    return f.spark.read.parquet(path).select("line_id", "raw_sentence", "parse_status")


@query("a02_append_errors", "errors", "SELECT error_type, count(*) AS n FROM errors GROUP BY 1")
def _(f):
    path = fresh_folder(f.spark, "errors")
    lake.append_rows(f.errors, path)
    return f.spark.read.parquet(path).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("a03_ingest", "lines", """SELECT 'RAW_LINES' AS folder, count(*) AS n FROM lines
 UNION ALL SELECT 'PARSE_ERRORS', count(*) FROM lines WHERE line_no % 29 = 0 OR (line_no % 19 = 0 AND line_no % 23 <> 0)
 UNION ALL SELECT 'PNORS', count(*) FROM lines WHERE line_no % 29 <> 0 AND line_no % 19 <> 0 AND line_no % 23 <> 0""")
def _(f):
    base, staging = fresh_folder(f.spark, "ingested"), fresh_folder(f.spark, "staging")
    lines = number_lines(read_lines(f.spark, _line_files(f), _stream_of(), "*.txt"))
    I.ingest(lines, base, staging)
    out = None
    for name in ("RAW_LINES", "PARSE_ERRORS", "PNORS"):
        part = f.spark.read.parquet(f"{base}/{name}").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("folder"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a03_ingest_again", "lines", """SELECT 'RAW_LINES' AS folder, count(*) AS n, count(DISTINCT raw_sentence) AS texts FROM lines
 UNION ALL SELECT 'PNORS', count(*), count(DISTINCT raw_sentence) FROM lines WHERE line_no % 29 <> 0 AND line_no % 19 <> 0 AND line_no % 23 <> 0""")
def _(f):
    """Two runs with one staging folder and different types, then the first run once more."""
    base, staging = fresh_folder(f.spark, "ingested"), fresh_folder(f.spark, "staging")
    good = "line_no % 29 <> 0 AND line_no % 19 <> 0 AND line_no % 23 <> 0"
    parts = {run: number_lines(read_lines(f.spark, _line_files(f, f"SELECT * FROM {{f:lines}} l WHERE {where}"), _stream_of(), "*.txt"))
             for run, where in (("good", good), ("rest", f"NOT ({good})"))}
    for run in ("good", "rest", "good"):
        I.ingest(parts[run], base, staging, run=run)
    out = None
    for name, column in (("RAW_LINES", "raw_sentence"), ("PNORS", "original_sentence")):
        part = lake.read_type(f.spark, base, name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("texts")).select(
            F.lit(name).alias("folder"), "n", "texts")
        out = part if out is None else out.unionByName(part)
    return out


@query("w01_gzip_file", "bursts34", f"""SELECT line_no, carried_date AS measurement_date, carried_time AS measurement_time, cell_index,
 true AS spread FROM ({CARRIED_SQL.replace("PARTITION BY stream_id, g", "PARTITION BY g").replace("PARTITION BY stream_id ORDER", "ORDER")})
 WHERE record_type = 'PNORC3' AND carried_date IS NOT NULL""")
def _(f):
    """All lines in one gzip file, which no reader can split; spread: their order is made in many segments."""
    path = fresh_folder(f.spark, "packed")
    f.burst_lines.coalesce(1).sortWithinPartitions("line_no").select("raw_sentence").write.option("compression", "gzip").text(path)
    lines = number_lines(read_lines(f.spark, path, F.lit("one"), "*.gz"), segment=512)
    parts = lines.select("segment").distinct().agg((F.count(F.lit(1)) > F.lit(1)).alias("spread"))
    done = I.with_headers(P.parse_lines(lines), LINE_CHUNK, LINE_ORDER)
    cells = P.typed_table(done, "pnorc34")
    return cells.select(F.round(F.col("speed") * 10000).cast("bigint").alias("line_no"), "measurement_date", "measurement_time",
                        F.col("cell_index").cast("int").alias("cell_index")).crossJoin(parts)


@query("a01_line_ids", "lines", "SELECT CAST(stream_id AS VARCHAR) AS stream_id, raw_sentence, row_number() OVER"
       " (PARTITION BY stream_id ORDER BY line_no) AS line_no, true AS same FROM lines")
def _(f):
    """Line numbers and ids of files read whole and in pieces of a few kilobytes."""
    path, key = _line_files(f), "spark.sql.files.maxPartitionBytes"
    old = f.spark.conf.get(key)
    kept = []
    try:
        for size in ("128m", "8k"):
            f.spark.conf.set(key, size)
            out = fresh_folder(f.spark, "numbered")
            number_lines(read_lines(f.spark, path, _stream_of(), "*.txt")).write.parquet(out)
            kept.append(f.spark.read.parquet(out))
    finally:
        f.spark.conf.set(key, old)
    whole, pieces = kept
    other = pieces.select("file_path", "line_no", F.col("line_id").alias("other"), F.col("raw_sentence").alias("text"))
    return whole.join(other, ["file_path", "line_no"], "left").select(
        "stream_id", "raw_sentence", "line_no",
        (F.col("line_id").eqNullSafe(F.col("other")) & F.col("raw_sentence").eqNullSafe(F.col("text"))).alias("same"))


@query("a04_lake_rows", "cells", "SELECT record_id, CAST(received_at AS DATE) AS date, cell_index, vel1,"
       " CAST(measurement_date || measurement_time AS BIGINT) AS measurement_id FROM cells")
def _(f):
    rows = f.spark.read.parquet(f"{_lake(f)}/PNORC")
    return rows.select("record_id", "date", "cell_index", "vel1", "measurement_id")


@query("a05_bulk_export", "sensor cells raw", """SELECT 'pnors12' AS table_name, count(*) AS row_count FROM sensor
 UNION ALL SELECT 'pnorc12', count(*) FROM cells UNION ALL SELECT 'raw_lines', count(*) FROM raw""")
def _(f):
    return lake.bulk_export({"pnors12": f.sensor, "pnorc12": f.cells, "raw_lines": f.raw, "unmapped": f.raw},
                            fresh_folder(f.spark, "export"))


@query("a06_line_files", "raw", """SELECT record_type, CAST(strftime(received_at, '%Y%m%d') AS INT) AS day, raw_sentence AS value
 FROM raw""")
def _(f):
    path = fresh_folder(f.spark, "daily")
    lake.write_line_files(f.raw, path)
    return f.spark.read.text(path).select("record_type", "day", "value")


@query("a07_error_files", "errors", """SELECT CASE WHEN attempted_prefix IN ('PNORS', 'PNORWD') THEN attempted_prefix || '_error' ELSE 'ERROR' END AS bucket,
 CAST(strftime(received_at, '%Y%m%d') AS INT) AS day, count(*) AS n FROM errors GROUP BY 1, 2""")
def _(f):
    path = fresh_folder(f.spark, "rejected")
    lake.write_error_files(f.errors.withColumn("raw_sentence", F.col("error_message")), path)
    return f.spark.read.text(path).groupBy("bucket", "day").agg(F.count(F.lit(1)).alias("n"))


@query("a08_blobs", "blob_lines", """SELECT stream_id, CAST(sum(strlen(raw_sentence)) AS BIGINT) AS bytes, count(*) AS lines
 FROM blob_lines WHERE is_bin GROUP BY 1""")
def _(f):
    path = fresh_folder(f.spark, "blobs")
    rows = f.blob_lines.withColumn("chunk", scans.line_chunk("line_no", 512))
    lake.write_blobs(scans.blob_parts(rows, "raw_sentence", F.col("is_bin"), ["stream_id"], ["chunk"], ["line_no"]), path)
    return f.spark.read.parquet(path).groupBy("stream_id").agg(
        F.sum(F.length("payload")).cast("bigint").alias("bytes"), F.sum("line_count").alias("lines"))


@query("a09_csv", "sensor", "SELECT record_id, heading, status_code FROM sensor WHERE CAST(received_at AS DATE) = DATE '2024-01-12'")
def _(f):
    path = fresh_folder(f.spark, "csv")
    lake.export_csv(K.on_day(f.sensor, date(2024, 1, 12)).select("record_id", "heading", "status_code"), path)
    return f.spark.read.option("header", True).schema("record_id bigint, heading double, status_code string").csv(path)


@query("a10_status_updates", "raw", """SELECT line_id, CASE WHEN line_id % 6 = 0 THEN 'OK' WHEN line_id % 3 = 0 THEN 'FAIL' ELSE parse_status END AS parse_status,
 CASE WHEN line_id % 6 = 0 THEN 'second' WHEN line_id % 3 = 0 THEN 'first' ELSE error_message END AS error_message FROM raw""")
def _(f):
    first = f.raw.where("line_id % 3 = 0").select("line_id", F.lit("FAIL").alias("parse_status"), F.lit("first").alias(
        "error_message"), F.lit(1).alias("update_no"))
    second = f.raw.where("line_id % 6 = 0").select("line_id", F.lit("OK").alias("parse_status"), F.lit("second").alias(
        "error_message"), F.lit(2).alias("update_no"))
    return lake.apply_status_updates(f.raw, first.unionByName(second)).select("line_id", "parse_status", "error_message")


@query("a10_written_back", "raw", """SELECT line_id, CASE WHEN line_id % 3 = 0 AND CAST(received_at AS DATE) = DATE '2024-01-08' THEN 'FAIL' ELSE parse_status END AS parse_status,
 CAST(received_at AS DATE) = DATE '2024-01-08' AS rewritten FROM raw""")
def _(f):
    base = fresh_folder(f.spark, "status")
    lake.write_lake(f.raw, base, "RAW_LINES")
    before = lake.list_files(f.spark, base).select("path").withColumn("kept", F.lit(True))
    before.write.parquet(f"{base}/_before")
    updates = f.raw.where("line_id % 3 = 0 AND CAST(received_at AS DATE) = DATE '2024-01-08'").select(
        "line_id", F.lit("FAIL").alias("parse_status"), F.lit(1).alias("update_no"))
    changed = lake.write_status_updates(f.spark, base, "RAW_LINES", updates)
    lake.compact(f.spark, base, "RAW_LINES", changed)  # the update itself writes no day again, this does
    days = lake.lake_files(f.spark, base).join(f.spark.read.parquet(f"{base}/_before"), "path", "left").groupBy("date").agg(
        F.bool_or(F.col("kept").isNull()).alias("rewritten"))
    return lake.read_type(f.spark, base, "RAW_LINES").join(days, "date", "left").select("line_id", "parse_status", "rewritten")


_MAINTAINED = """SELECT line_id, CASE WHEN line_id % 3 = 0 THEN 'FAIL' ELSE parse_status END AS parse_status,
 CASE WHEN line_id % 6 = 0 THEN 'second' WHEN line_id % 3 = 0 THEN 'first' ELSE error_message END AS error_message{0} FROM raw"""


def _runs_and_updates(f):
    """Two runs, and two updates of the same lines that have been told; base and a way to tell all again."""
    base = fresh_folder(f.spark, "maintained")

    def tell() -> None:
        for run in (0, 1):
            lake.write_run(f.raw.where(f"line_id % 2 = {run}"), base, "RAW_LINES", str(run))
        for no, (name, step) in enumerate((("first", 3), ("second", 6))):
            rows = f.raw.where(f"line_id % {step} = 0").select(
                "line_id", F.lit("FAIL").alias("parse_status"), F.lit(name).alias("error_message"), F.lit(no).alias("update_no"))
            lake.write_status_updates(f.spark, base, "RAW_LINES", rows, run=name)

    tell()
    return base, tell


@query("a10_merge_on_read", "raw", _MAINTAINED.format(", true AS kept"))
def _(f):
    """Updates as overlays: every file that was there before them is there after them."""
    base = fresh_folder(f.spark, "overlays")
    lake.write_run(f.raw, base, "RAW_LINES", "0")
    before = lake.lake_files(f.spark, base).select("path", "bytes")
    before.write.parquet(f"{base}/_before")
    for no, (name, step) in enumerate((("first", 3), ("second", 6))):
        rows = f.raw.where(f"line_id % {step} = 0").select(
            "line_id", F.lit("FAIL").alias("parse_status"), F.lit(name).alias("error_message"), F.lit(no).alias("update_no"))
        lake.write_status_updates(f.spark, base, "RAW_LINES", rows)
    gone = f.spark.read.parquet(f"{base}/_before").exceptAll(before)
    kept = gone.agg((F.count(F.lit(1)) == 0).alias("kept"))
    return lake.read_type(f.spark, base, "RAW_LINES").select("line_id", "parse_status", "error_message").crossJoin(kept)


@query("a04_maintenance", "raw", _MAINTAINED.format(""))
def _(f):
    """Runs, updates, a compaction that dies before it counts, one that does not, and all of it told again."""
    base, tell = _runs_and_updates(f)
    days = [date.fromisoformat(d) for d in G.days_below(f.spark, f"{base}/RAW_LINES")]
    own = G.commit

    def dies(*_, **__):
        raise InterruptedError

    G.commit = dies
    try:
        lake.compact(f.spark, base, "RAW_LINES", days[::2])
    except InterruptedError:
        pass
    finally:
        G.commit = own
    tell()
    lake.compact(f.spark, base, "RAW_LINES", days[1:])
    tell()
    return lake.read_type(f.spark, base, "RAW_LINES").select("line_id", "parse_status", "error_message")


@query("s03_skipped_files", "sensor", """SELECT record_id, received_at, 'hour' AS asked, true AS few FROM sensor
 WHERE received_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-10 07:00:00'
 UNION ALL SELECT record_id, received_at, 'id', true FROM sensor WHERE record_id = (SELECT max(record_id) // 2 FROM sensor)""")
def _(f):
    """An hour and an id through the index; few: at most an eighth of the files, or two, are opened."""
    base = fresh_folder(f.spark, "indexed")
    lake.write_run(f.sensor, base, "PNORS", "0")
    skipping.index_files(f.spark, base, "PNORS", ["received_at"], ["record_id", "head_id"])
    every = lake.lake_files(f.spark, base).count()
    some = f.sensor.agg(F.max("record_id")).first()[0] // 2
    hour = (datetime(2024, 1, 10, 6), datetime(2024, 1, 10, 7))
    out = None
    for asked, got in (("hour", skipping.read_matching(f.spark, base, "PNORS", between={"received_at": hour})),
                       ("id", skipping.read_matching(f.spark, base, "PNORS", equal={"record_id": some}))):
        few = len(got.inputFiles()) <= max(2, every // 8)
        got = got.select("record_id", "received_at", F.lit(asked).alias("asked"), F.lit(few).alias("few"))
        out = got if out is None else out.unionByName(got)
    return out


@query("a11_retained_rows", "raw", "SELECT line_id FROM raw WHERE received_at >= TIMESTAMP '2024-01-10 12:00:00'")
def _(f):
    """Old days go as folders, old rows of the day of the cut by an overlay."""
    base = fresh_folder(f.spark, "retained-rows")
    lake.write_run(f.raw, base, "RAW_LINES", "0")
    lake.drop_expired(f.spark, base, "RAW_LINES", 5, NOON, rows="received_at")
    return lake.read_type(f.spark, base, "RAW_LINES").select("line_id")


@query("a11_dropped_days", "raw", "SELECT line_id FROM raw WHERE CAST(received_at AS DATE) >= DATE '2024-01-10'")
def _(f):
    base = fresh_folder(f.spark, "retained")
    lake.write_lake(f.raw, base, "RAW_LINES")
    lake.drop_expired(f.spark, base, "RAW_LINES", 5, NOON)
    return lake.read_type(f.spark, base, "RAW_LINES").select("line_id")


@query("a11_retention", "raw", "SELECT line_id FROM raw WHERE received_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '5 days'")
def _(f):
    return lake.retain_days(f.raw, 5, NOON).select("line_id")


@query("a12_month_slices", "", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(f):
    path = fresh_folder(f.spark, "months")
    lake.write_by_month(f.table("orders"), path, ts="o_orderdate")
    return f.spark.read.option("recursiveFileLookup", False).parquet(path).groupBy(
        F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- J7: views over the lake
@query("j07_lake_views", "waves energy bands coefs dirs", """SELECT w.record_id, w.hm0, f.coefficient_flag, wd.direction_type,
 b.hmo AS band_hm0, e.num_frequencies IS NOT NULL AS has_energy FROM waves w LEFT JOIN energy e ON w.received_at = e.received_at
 LEFT JOIN bands b ON w.received_at = b.received_at LEFT JOIN coefs f ON w.received_at = f.received_at
 LEFT JOIN dirs wd ON w.received_at = wd.received_at""")
def _(f):
    base = fresh_folder(f.spark, "waves")
    for name, df in (("PNORW", f.waves), ("PNORE", f.energy), ("PNORB", f.bands), ("PNORF", f.coefs), ("PNORWD", f.dirs)):
        lake.write_lake(df, base, name)
    frames = lake.read_lake(f.spark, base, ["PNORW", "PNORE", "PNORB", "PNORF", "PNORWD"])
    out = V.lake_views(frames)["wave_measurement_full"]
    return out.select("record_id", "hm0", "coefficient_flag", "direction_type", "band_hm0",
                      F.col("energy_start_freq").isNotNull().alias("has_energy"))


# ------------------------------------------------------------------------------ M: upgrade
def _old_sensor(f, data_format: int):
    s = f.sensor.where(f"data_format = {data_format}").drop("data_format")
    none = F.when(F.col("record_id") % 2 == 0, F.col("heading") / 100)
    return s.withColumns({
        "original_sentence": F.lit("raw"), "checksum": F.lit("ABC"),
        "measurement_date": F.concat("measurement_date", F.lit("xx")), "heading_std_dev": none, "pitch_std_dev": none,
        "roll_std_dev": none, "pressure_std_dev": none, "error_code": F.col("error_code").cast("string")})


def _old_cells(f, data_format: int):
    c = f.cells.where(f"data_format = {data_format}").drop("data_format")
    return c.withColumns({"original_sentence": F.lit("raw"), "checksum": F.lit("ABC"),
                          "corr2": F.col("corr1"), "corr3": F.col("corr1"), "corr4": F.lit(None).cast("int")})


@query("m01_energy", "energy", "SELECT record_id, 'PNORE' AS sentence_type, measurement_date, substring(measurement_time, 1, 6) AS measurement_time,"
       " 'AB' AS checksum, round(list_sum(energy_densities), 6) AS total FROM energy")
def _(f):
    old = f.energy.withColumns({"measurement_time": F.concat("measurement_time", F.lit("00")),
                                "original_sentence": F.lit("raw"), "checksum": F.lit("ABC")})
    return rounded(M.energy(old).select(
        "record_id", "sentence_type", "measurement_date", "measurement_time", "checksum",
        F.aggregate("energy_densities", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("m02_configs", "configs", "SELECT data_format, head_id, cell_count, blanking_distance, checksum FROM configs WHERE data_format > 100")
def _(f):
    old = {"pnori1": f.configs.where("data_format = 101"), "pnori2": f.configs.where("data_format = 102")}
    return M.consolidate("pnori12", old).select("data_format", "head_id", "cell_count", "blanking_distance", "checksum")


@query("m03_sensors_12", "sensor", """SELECT data_format, received_at, measurement_date, error_code, heading,
 CASE WHEN record_id % 2 = 0 THEN heading / 100 ELSE 0 END AS heading_std_dev, 'AB' AS checksum FROM sensor WHERE data_format IN (101, 102)""")
def _(f):
    out = M.consolidate("pnors12", {"pnors_df101": _old_sensor(f, 101), "pnors_df102": _old_sensor(f, 102)})
    return out.select("data_format", "received_at", "measurement_date", "error_code", "heading", "heading_std_dev", "checksum")


@query("m04_sensors_34", "sensor", "SELECT data_format, received_at, measurement_date, pressure, temperature FROM sensor WHERE data_format IN (103, 104)")
def _(f):
    out = M.consolidate("pnors34", {"pnors_df103": _old_sensor(f, 103), "pnors_df104": _old_sensor(f, 104)})
    return out.select("data_format", "received_at", "measurement_date", "pressure", "temperature")


@query("m05_cells_12", "cells", """SELECT data_format, received_at, cell_index, coalesce(cell_distance, 0) AS cell_distance, vel4,
 coalesce(amp4, 0) AS amp4, corr1, 0 AS corr4 FROM cells WHERE data_format IN (101, 102)""")
def _(f):
    out = M.consolidate("pnorc12", {"pnorc_df101": _old_cells(f, 101), "pnorc_df102": _old_cells(f, 102)})
    return out.select("data_format", "received_at", "cell_index", "cell_distance", "vel4", "amp4", "corr1", "corr4")


@query("m06_cells_34", "cells", """SELECT data_format, received_at, cell_index, coalesce(cell_distance, 0) AS cell_distance, speed, direction
 FROM cells WHERE data_format IN (103, 104)""")
def _(f):
    out = M.consolidate("pnorc34", {"pnorc_df103": _old_cells(f, 103), "pnorc_df104": _old_cells(f, 104)})
    return out.select("data_format", "received_at", "cell_index", "cell_distance", "speed", "direction")


@query("m07_headers", "sensor", """SELECT data_format, received_at, CASE WHEN error_code = 3 THEN 0 ELSE error_code END AS error_code, status_code
 FROM sensor WHERE data_format IN (103, 104)""")
def _(f):
    old = lambda d: f.sensor.where(f"data_format = {d}").drop("data_format").withColumns({
        "original_sentence": F.lit("raw"), "checksum": F.lit("A"), "error_code": F.when(F.col("error_code") != 3, F.col("error_code"))})
    return M.consolidate("pnorh", {"pnorh_df103": old(103), "pnorh_df104": old(104)}).select(
        "data_format", "received_at", "error_code", "status_code")


def _old_waves(f):
    return f.waves.withColumns({
        "sentence_type": F.lit("PNORW"), "original_sentence": F.lit("raw"), "hmax": F.col("hm0") * 2, "tm02": F.col("tp") / 2,
        "mean_period": F.col("tp") / 3, "peak_dir": F.col("main_dir"), "peak_directional_spread": F.col("main_dir") / 4,
        "mean_dir": F.col("main_dir") / 2, "checksum": F.lit("ABC")}).drop("main_dir")


@query("m08_waves", "waves", """SELECT record_id, hm0, hm0 * 2 AS hmax, round(tp / 3, 2) AS tz, main_dir AS dir_tp, main_dir / 2 AS main_dir,
 CAST(NULL AS DOUBLE) AS h3, CAST(NULL AS INT) AS num_no_detects, 'AB' AS checksum FROM waves""")
def _(f):
    out = M.waves(_old_waves(f))
    return out.select("record_id", *[F.col(c).cast("double").alias(c) for c in ("hm0", "hmax", "tz", "dir_tp", "main_dir", "h3")],
                      "num_no_detects", "checksum")


@query("m09_upgrade_counts", "sensor cells waves raw", """SELECT table_name, CAST(row_count AS BIGINT) AS row_count FROM (
 SELECT 'echo_data->pnore_data' AS table_name, 0 AS row_count UNION ALL SELECT 'old->pnori12', 0
 UNION ALL SELECT 'old->pnors12', count(*) FROM sensor WHERE data_format IN (101, 102)
 UNION ALL SELECT 'old->pnors34', 0 UNION ALL SELECT 'old->pnorc12', count(*) FROM cells WHERE data_format = 101
 UNION ALL SELECT 'old->pnorc34', 0 UNION ALL SELECT 'old->pnorh', 0 UNION ALL SELECT 'pnorw_data (renamed)', count(*) FROM waves
 UNION ALL SELECT t || ' (kept)', 0 FROM (SELECT unnest(['pnori', 'pnors_df100', 'pnorc_df100', 'pnorb_data', 'pnorf_data', 'pnorwd_data', 'pnora_data', 'parse_errors']) AS t)
 UNION ALL SELECT 'raw_lines (kept)', count(*) FROM raw)""")
def _(f):
    return M.upgrade_counts({
        "pnors_df101": _old_sensor(f, 101), "pnors_df102": _old_sensor(f, 102), "pnorc_df101": _old_cells(f, 101),
        "pnorw_data": _old_waves(f), "raw_lines": f.raw})


# ----------------------------------------------------------------- C, V: metadata, functions
@query("c01_sources", "sensor cells", """SELECT 'pnorc12' AS source, 'Pnorc12' AS display_name, 'Velocity Data' AS category, count(*) AS record_count FROM cells
 UNION ALL SELECT 'pnors12', 'Pnors12', 'Sensor Data', count(*) FROM sensor UNION ALL SELECT 'my_log', 'MY Log', 'Other', count(*) FROM sensor""")
def _(f):
    return C.sources(f.spark, {"pnors12": f.sensor, "pnorc12": f.cells, "my_log": f.sensor, "_hidden": f.raw}).select(
        "source", "display_name", "category", "record_count")


@query("c02_describe", "waves", """SELECT 'waves' AS source, column_name, kind AS column_type, n FROM (SELECT unnest(['record_id', 'received_at',
 'measurement_date', 'measurement_time', 'spectrum_basis', 'processing_method', 'hm0', 'tp', 'main_dir', 'wave_error_code']) AS column_name,
 unnest(['NUMERIC', 'TIMESTAMP', 'TEXT', 'TEXT', 'NUMERIC', 'NUMERIC', 'NUMERIC', 'NUMERIC', 'NUMERIC', 'TEXT']) AS kind) c
 CROSS JOIN (SELECT count(*) AS n FROM waves) w""")
def _(f):
    return C.describe(f.spark, "waves", f.waves).select("source", "column_name", "column_type").crossJoin(
        f.waves.agg(F.count(F.lit(1)).alias("n")))


@query("c04_resolve", "sensor cells", """SELECT name, n FROM (SELECT unnest(['pnors_df100', 'PNORC12', 'pnorw_data', 'chosen']) AS name) x LEFT JOIN
 (SELECT 'pnors_df100' AS name, count(*) AS n FROM sensor UNION ALL SELECT 'PNORC12', count(*) FROM cells UNION ALL SELECT 'chosen', count(*) FROM sensor) y
 USING (name)""")
def _(f):
    names = [*lake.register_lake_views(f.spark, _lake(f), "pq_"), "chosen"]
    f.sensor.createOrReplaceTempView("chosen")
    out = None
    for name in ("pnors_df100", "PNORC12", "pnorw_data", "chosen"):
        view = C.resolve(name, set(names))
        n = f.spark.table(view).agg(F.count(F.lit(1)).alias("n")) if view else f.spark.range(1).select(F.lit(None).cast("bigint").alias("n"))
        part = n.select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("c05_columns", "bands", """SELECT 'record_id' AS name, count(record_id) AS n FROM bands UNION ALL SELECT 'received_at', count(received_at) FROM bands
 UNION ALL SELECT 'measurement_date', count(measurement_date) FROM bands UNION ALL SELECT 'measurement_time', count(measurement_time) FROM bands
 UNION ALL SELECT 'band', count(band) FROM bands UNION ALL SELECT 'hmo', count(hmo) FROM bands UNION ALL SELECT 'tp', count(tp) FROM bands
 UNION ALL SELECT 'main_dir', count(main_dir) FROM bands""")
def _(f):
    names = [name for name, _ in C.columns(f.bands)]
    counts = f.bands.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])))


@query("c06_free_sql", "sensor", "SELECT data_format, count(*) AS n, round(avg(heading), 6) AS heading FROM sensor WHERE pitch > 0 GROUP BY 1")
def _(f):
    return rounded(C.run_sql(f.spark, "SELECT data_format, count(*) AS n, avg(heading) AS heading FROM sensor_rows WHERE pitch > 0"
                             " GROUP BY data_format", {"sensor_rows": f.sensor}))


@query("v02_sql_functions", "lines", """SELECT line_no, {XOR:regexp_replace(string_split(raw_sentence, '*')[1], '^[$]', '')} AS checksum,
 CASE WHEN contains(raw_sentence, '*') THEN checksum = upper(string_split(raw_sentence, '*')[-1]) END AS ok FROM lines""")
def _(f):
    C.register_sql_functions(f.spark)
    return C.run_sql(f.spark, "SELECT line_no, nmea_checksum(raw_sentence) AS checksum, nmea_checksum_ok(raw_sentence) AS ok FROM log_rows",
                     {"log_rows": f.lines})


@query("v02_table_functions", "sensor cells", """SELECT CAST(s.stream_id AS VARCHAR) AS stream_id, 'hours' AS asked, count(*) AS n, sum(k)::BIGINT AS k,
 round(sum(t), 4) AS total FROM (SELECT stream_id, time_bucket(INTERVAL '60 minutes', received_at, TIMESTAMP '2000-01-03') AS b, count(*) AS k,
  avg(temperature) AS t FROM sensor GROUP BY 1, 2) s GROUP BY 1
 UNION ALL SELECT CAST(stream_id AS VARCHAR), 'profile', count(*), sum(cell_index)::BIGINT,
  round(sum(coalesce(cell_distance, 0.5 + cell_index * 2.0)), 4) FROM cells
 JOIN (SELECT stream_id, max(measured_at) AS measured_at FROM cells GROUP BY 1) USING (stream_id, measured_at) GROUP BY 1""")
def _(f):
    f.sensor.createOrReplaceTempView("some_sensors")
    f.cells.createOrReplaceTempView("some_cells")
    C.register_table_functions(f.spark, "some_sensors", "some_cells")
    return C.run_sql(f.spark, """
        SELECT CAST(s.stream_id AS STRING) AS stream_id, 'hours' AS asked, count(*) AS n, sum(b.readings) AS k,
          round(sum(b.mean_temperature), 4) AS total
        FROM (SELECT DISTINCT stream_id FROM some_sensors) s, LATERAL sensor_buckets(CAST(s.stream_id AS STRING), 60) b GROUP BY 1
        UNION ALL SELECT CAST(c.stream_id AS STRING), 'profile', count(*), sum(p.cell_index), round(sum(p.depth), 4)
        FROM (SELECT stream_id, max(measured_at) AS at FROM some_cells GROUP BY 1) c,
          LATERAL velocity_profile(CAST(c.stream_id AS STRING), c.at, 0.5D, 2.0D) p GROUP BY 1""")


# ----------------------------------------------------------------------------- R: streams
@query("r01_stream_ingest", "lines", """SELECT CAST(stream_id AS VARCHAR) AS stream_id, parse_status, count(*) AS n FROM (SELECT stream_id,
 CASE WHEN line_no % 29 = 0 OR (line_no % 19 = 0 AND line_no % 23 <> 0) THEN 'FAIL' WHEN line_no % 23 = 0 THEN 'PENDING' ELSE 'OK' END AS parse_status
 FROM lines) GROUP BY 1, 2""")
def _(f):
    base = fresh_folder(f.spark, "live")
    lines = stream_lines(f.spark, _line_files(f), _stream_of(), 4, "*.txt")
    live.LineIngest(base).start(lines, fresh_folder(f.spark, "state"), available_now=True).awaitTermination()
    return f.spark.read.parquet(f"{base}/RAW_LINES").groupBy("stream_id", "parse_status").agg(F.count(F.lit(1)).alias("n"))


@query("r02_stream_lake", "lines", """SELECT 'PNORS' AS record_type, count(*) AS n, round(sum((line_no * 37) % 3600 / 10.0e0), 4) AS total, 1 AS views
 FROM lines WHERE line_no % 29 <> 0 AND line_no % 19 <> 0 AND line_no % 23 <> 0 UNION ALL SELECT 'RAW_LINES', count(*), NULL, 1 FROM lines""")
def _(f):
    """What a stream and a batch run wrote into one lake, half of the lines each, by the lake's readers."""
    base, staging = fresh_folder(f.spark, "one-lake"), fresh_folder(f.spark, "staging")
    halves = [_line_files(f, f"SELECT * FROM {{f:lines}} l WHERE line_no % 2 = {k}") for k in (0, 1)]
    lines = stream_lines(f.spark, halves[0], _stream_of(), 4, "*.txt")
    live.LineIngest(base).start(lines, fresh_folder(f.spark, "state"), available_now=True).awaitTermination()
    I.ingest(number_lines(read_lines(f.spark, halves[1], _stream_of(), "*.txt")), base, staging, run="batch")
    seen = {r.record_type for r in lake.lake_inventory(f.spark, base).where("files > 0").collect()}
    frames, out = lake.read_lake(f.spark, base, ["PNORS", "RAW_LINES"]), None
    for name in frames:
        views = lake.register_lake_views(f.spark, base, "live_", types=[name]) if name in seen else []
        total = F.round(F.sum(F.col("heading").cast("double")), 4) if name == "PNORS" else F.lit(None).cast("double")
        part = f.spark.table(views[0]).agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(
            F.lit(name).alias("record_type"), "n", "total", F.lit(len(views)).alias("views"))
        out = part if out is None else out.unionByName(part)
    return out


@query("r07_bounded_batches", "lines", "SELECT CAST(ceil(count(DISTINCT stream_id) / 3.0) AS INT) AS batches, count(*) AS n FROM lines")
def _(f):
    out = fresh_folder(f.spark, "bounded")
    lines = stream_lines(f.spark, _line_files(f), _stream_of(), 3, "*.txt")
    q = lines.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option(
        "checkpointLocation", fresh_folder(f.spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return f.spark.read.parquet(out).agg(F.countDistinct("batch").cast("int").alias("batches"), F.count(F.lit(1)).alias("n"))


@query("r03_live_buckets", "sensor", """SELECT time_bucket(INTERVAL '5 minutes', received_at) AS bucket, round(sum(pressure), 4) AS value
 FROM sensor GROUP BY 1""")
def _(f):
    source, out = fresh_folder(f.spark, "sensor"), fresh_folder(f.spark, "buckets")
    rows = f.sensor.select("received_at", "pressure")
    rows.repartitionByRange("received_at").sortWithinPartitions("received_at").write.parquet(source)
    stream = f.spark.readStream.schema("received_at timestamp_ntz, pressure double").parquet(source)
    live_rows = live.live_buckets(stream, "pressure", 5, "sum")
    q = live_rows.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", fresh_folder(f.spark, "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(live.completed(f.spark.read.parquet(out), f.spark.read.parquet(source), "pressure", 5, "sum"), 4)


def _two_batches(f, rows) -> live.LineIngest:
    """Lines as two landings per stream, streamed in two batches with a restart between them."""
    source, base, state = (fresh_folder(f.spark, n) for n in ("landing", "live", "state"))
    middle = rows.agg(F.percentile_approx("line_no", 0.5).alias("m")).scalar()
    job = live.LineIngest(base)
    for part in (rows.where(F.col("line_no") < middle), rows.where(F.col("line_no") >= middle)):
        part.repartition("stream_id").sortWithinPartitions("stream_id", "line_no").select(
            "stream_id", "raw_sentence").write.mode("append").partitionBy("stream_id").text(source)
        lines = stream_lines(f.spark, source, _stream_of(), 1000, "*.txt")
        job.start(lines, state, available_now=True).awaitTermination()
    return job


@query("r04_blobs_over_batches", "byte_lines", """SELECT CAST(stream_id AS VARCHAR) AS stream_id, count(*) AS blobs, CAST(sum(b) AS BIGINT) AS bytes FROM (
 SELECT stream_id, g, sum(strlen(raw_sentence)) AS b FROM (SELECT *, count(*) FILTER (WHERE NOT is_bin) OVER (PARTITION BY stream_id ORDER BY line_no) AS g FROM byte_lines)
 WHERE is_bin GROUP BY 1, 2) GROUP BY 1""")
def _(f):
    job = _two_batches(f, f.byte_lines)
    errors = f.spark.read.parquet(f"{job.base}/PARSE_ERRORS").where("error_type = 'BINARY_DATA'").groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("blobs"))
    parts = f.spark.read.parquet(f"{job.base}/BLOBS").groupBy("stream_id").agg(F.sum("byte_count").cast("bigint").alias("bytes"))
    return errors.join(parts, "stream_id").select("stream_id", "blobs", "bytes")


@query("r05_headers_over_batches", "bursts34", f"""SELECT CAST(stream_id AS VARCHAR) AS stream_id, line_no, carried_date AS measurement_date,
 carried_time AS measurement_time, cell_index FROM ({CARRIED_SQL}) WHERE record_type = 'PNORC3' AND carried_date IS NOT NULL""")
def _(f):
    job = _two_batches(f, f.burst_lines)
    cells = f.spark.read.parquet(f"{job.base}/PNORC34")
    return cells.select("stream_id", F.round(F.col("speed") * 10000).cast("bigint").alias("line_no"), "measurement_date",
                        "measurement_time", F.col("cell_index").cast("int").alias("cell_index"))


#: Seconds before noon at which the lines of some streams came; all others came ten minutes before.
_AGES = {0: 30, 1: 240}


@query("r06_live_health", "lines", """SELECT count(*) AS total_lines, count(*) FILTER (WHERE stream_id = 0) AS last_minute,
 count(*) FILTER (WHERE stream_id IN (0, 1)) AS last_5_minutes,
 count(*) FILTER (WHERE line_no % 29 = 0 OR (line_no % 19 = 0 AND line_no % 23 <> 0)) AS error_count,
 CASE min(stream_id) WHEN 0 THEN 30 WHEN 1 THEN 240 ELSE 600 END AS age_seconds, true AS alive FROM lines""")
def _(f):
    """The tables that a stream keeps of itself; its files came at set times before noon."""
    base, source = fresh_folder(f.spark, "watched"), _line_files(f)
    for path in G.names(f.spark, f"{source}/*/*.txt"):
        age = _AGES.get(int(path.split("stream_id=")[1].split("/")[0]), 600)
        files, where = G.store(f.spark, path)
        files.setTimes(where, int((NOON - timedelta(seconds=age)).replace(tzinfo=timezone.utc).timestamp() * 1000), -1)
    table = live.ProgressTable(f.spark, base)
    f.spark.streams.addListener(table)
    try:
        lines = stream_lines(f.spark, source, _stream_of(), 3, "*.txt")
        job = live.LineIngest(base, clock=lambda: NOON).start(lines, fresh_folder(f.spark, "state"), available_now=True)
        job.awaitTermination()
        last = job.lastProgress["batchId"]
        for _ in range(100):  # the listener is told a moment after the batch
            if any(p.endswith(f"-{last:012d}.json") for p in G.names(f.spark, f"{table.path}/*.json")):
                break
            time.sleep(0.1)
    finally:
        f.spark.streams.removeListener(table)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    alive = live.stream_health(f.spark, base, now).select((F.col("heartbeat_age_seconds").between(0, 600)).alias("alive"))
    return live.stream_health(f.spark, base, NOON).select(
        "total_lines", "last_minute", "last_5_minutes", "error_count", "age_seconds").crossJoin(alive)


@query("r06_health", "raw errors", """SELECT count(*) AS total_lines, count(*) FILTER (WHERE received_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '1 minute') AS last_minute,
 count(*) FILTER (WHERE received_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '5 minutes') AS last_5_minutes,
 (SELECT count(*) FROM errors) AS error_count, max(received_at) AS newest FROM raw""")
def _(f):
    return live.ingest_health(f.raw, f.errors, NOON).drop("age_seconds")
