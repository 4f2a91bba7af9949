"""The record lake: Parquet below ``{base}/{TYPE}/date=YYYY-MM-DD/``."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake import layouts as L
from brinelake.functions import sentences as S
from brinelake.operators import filters, unions
from brinelake.sources import footers
from brinelake.sources import generations as G

# Seconds after which an unfinished file is late, and after which it is stuck.
FIRST_RETRY_SECONDS = 15
FAULT_SECONDS = 45

UNFINISHED = "*.writing"


# ------------------------------------------------------------------------------- writing
def with_day(df: DataFrame, ts: str = "received_at") -> DataFrame:
    """Lake columns: the day of receipt, and the burst as one integer where it is known."""
    if {"measurement_date", "measurement_time"} <= set(df.columns) and "measurement_id" not in df.columns:
        df = df.withColumn("measurement_id", S.measurement_id("measurement_date", "measurement_time"))
    return df.withColumn("date", F.to_date(F.col(ts)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle for a partitioned write: rows of one folder together, in pieces of even size.

    The adaptive rebalance cuts a folder that holds very many rows (a busy day, one type with
    a third of everything) over many tasks and puts small folders together, by the sizes it
    sees, so no number of files has to be guessed.
    """
    return df.hint("rebalance", *keys)


def write_lake(df: DataFrame, base: str, record_type: str, mode: str = "append",
               ts: str = "received_at") -> None:
    """A4: one type, by day of receipt, sorted for row-group skipping.

    The commit protocol of the writer makes the files appear together or not at all. A type that
    has a table of what counts (``generations``) gets the rows as a run of their own instead.
    """
    spark, folder = df.sparkSession, f"{base.rstrip('/')}/{record_type}"
    if G.current(spark, folder) is not None:
        write_run(df, base, record_type, uuid.uuid4().hex, ts, replace_all=mode == "overwrite")
        return
    rows = spread(with_day(df, ts), "date")
    inner = [c for c in (ts, "cell_index") if c in rows.columns]
    rows.sortWithinPartitions("date", *inner).write.mode(mode).partitionBy("date").parquet(folder)


def _write_part(rows: DataFrame, folder: str, part: str, ts: str = "received_at") -> list[str]:
    """Rows with their ``date`` as one part, beside what counts; returns the days they lie in."""
    rows = spread(rows.withColumn("batch_id", F.lit(part)), "date")
    inner = [c for c in (ts, "cell_index") if c in rows.columns]
    rows.sortWithinPartitions("date", *inner).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(folder)
    return G.days_below(rows.sparkSession, folder, part)


def write_run(df: DataFrame, base: str, record_type: str, run: str, ts: str = "received_at",
              replace_all: bool = False) -> bool:
    """Rows of one run or batch below ``date=.../batch_id=...``, all of them or none.

    They count once all files stand. A run that is in already, also if its files were compacted or
    updated since, writes nothing (False): the rows of a run are always the same.  What a run left
    that died is overwritten by its next attempt.
    """
    spark, folder = df.sparkSession, f"{base.rstrip('/')}/{record_type}"
    before = G.ensured(spark, folder)
    if before.has_run(run):
        return False
    days = _write_part(with_day(df, ts), folder, run, ts)
    gone = before.pairs() if replace_all else set()
    G.commit(spark, folder, lambda g: g.without(gone, before.marks() if replace_all else set())
             .with_part(run, days).with_run(run))
    return True


def compact(spark: SparkSession, base: str, record_type: str, days: list[date], purge: bool = True) -> None:
    """A4: the files of some days, runs, batches and updates, as few larger ones.

    One job writes all days beside the old files; then the table of what counts is replaced.
    ``purge`` deletes the old files at once; without it queries that run can end on them.
    """
    folder = f"{base.rstrip('/')}/{record_type}"
    names = {d.isoformat() for d in days}
    now = G.ensured(spark, folder)
    pairs, marks = now.pairs(names.__contains__), now.marks(names.__contains__)
    if not pairs:
        return
    part = G.COMPACTED + uuid.uuid4().hex
    rows = read_pairs(spark, folder, now, pairs)
    written = _write_part(rows.where(F.col("date").isNotNull()), folder, part)
    G.commit(spark, folder, lambda g: g.without(pairs, marks).with_part(part, written) if written
             else g.without(pairs, marks), needs=pairs, marks=marks)
    if purge:
        G.purge(spark, folder)


def bulk_export(tables: dict[str, DataFrame], base: str, mode: str = "append") -> DataFrame:
    """A5: every mapped table into the lake; returns the rows the lake now holds per table."""
    done: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if name in L.LAKE_TYPES:
            write_lake(df, base, L.LAKE_TYPES[name], mode)
            done[name] = df.sparkSession.read.parquet(f"{base.rstrip('/')}/{L.LAKE_TYPES[name]}")
    from brinelake.operators.aggregates import row_counts

    return row_counts(done)


def write_by_month(df: DataFrame, path: str, mode: str = "append", ts: str = "received_at") -> None:
    """Month slices."""
    rows = df.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))
    spread(rows, "month").write.mode(mode).partitionBy("month").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """A1, A2: append log rows."""
    df.write.mode("append").parquet(path)


def write_records(tables: dict[str, DataFrame], base: str, mode: str = "append") -> None:
    """A3: typed rows, each table to its folder of the lake."""
    for name, df in tables.items():
        write_lake(df, base, L.LAKE_TYPES.get(name, name.upper()), mode)


def write_line_files(lines: DataFrame, path: str, mode: str = "append", ts: str = "received_at",
                     order: list[str] | None = None) -> None:
    """Lines back to text files by type and day, each file in order of ``order``."""
    rows = lines.where(F.col("record_type").isNotNull()).withColumn(
        "day", F.date_format(F.col(ts), "yyyyMMdd"))
    rows = spread(rows, "record_type", "day").sortWithinPartitions("record_type", "day", *(order or [ts]))
    rows.select("record_type", "day", "raw_sentence").write.mode(mode).partitionBy(
        "record_type", "day").text(path)


def error_bucket(record_type: Column | str = "record_type") -> Column:
    """Known types have a file of their own, everything else shares one."""
    c = F.col(record_type) if isinstance(record_type, str) else record_type
    return F.when(c.isin(*L.ERROR_FILE_TYPES), F.concat(c, F.lit("_error"))).otherwise(F.lit("ERROR"))


def write_error_files(errors: DataFrame, path: str, mode: str = "append",
                      record_type: str = "attempted_prefix", ts: str = "received_at") -> None:
    """Rejected lines by bucket and day."""
    rows = errors.select(error_bucket(record_type).alias("bucket"),
                         F.date_format(F.col(ts), "yyyyMMdd").alias("day"), "raw_sentence")
    spread(rows, "bucket", "day").write.mode(mode).partitionBy("bucket", "day").text(path)


def write_blobs(parts: DataFrame, path: str, mode: str = "append") -> None:
    """Blob parts (``scans.blob_parts``); ordered by chunk and part they are the blob."""
    if "started_at" not in parts.columns:
        parts.write.mode(mode).parquet(path)
        return
    rows = spread(parts.withColumn("date", F.to_date("started_at")), "date")
    rows.write.mode(mode).partitionBy("date").parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Query result as CSV files with header lines."""
    df.write.mode(mode).option("header", True).csv(path)


def apply_status_updates(raw: DataFrame, updates: DataFrame, id_col: str = "line_id",
                         sequence: str = "update_no") -> DataFrame:
    """A10: raw lines under the latest status update of their id.

    ``updates`` has the id, ``parse_status``, and optionally ``record_type``,
    ``checksum_valid`` and ``error_message`` whose NULLs leave the old value.
    """
    changed = [c for c in ("parse_status", "record_type", "checksum_valid", "error_message")
               if c in updates.columns]
    latest = updates.groupBy(id_col).agg(F.max_by(F.struct(*changed), sequence).alias("_u"))
    joined = raw.join(latest, id_col, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_u.{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in raw.columns])


#: Columns that a status update can change.
UPDATED = ("parse_status", "record_type", "checksum_valid", "error_message")


def write_status_updates(spark: SparkSession, base: str, record_type: str, updates: DataFrame,
                         id_col: str | list[str] | None = None, sequence: str = "update_no",
                         run: str | None = None) -> list[date]:
    """A10: the updates as an overlay of positions; no day is written again.

    Lines are found by ``file_path`` and ``line_no`` where the updates have them, else by
    ``line_id``. An overlay row names a file and a row in it, with the values that hold from now
    on; readers apply it, ``compact`` folds it in. With the id of a run the same updates can be
    told again without effect. Returns the days that hold an updated line.
    """
    key = [id_col] if isinstance(id_col, str) else id_col or (
        ["file_path", "line_no"] if {"file_path", "line_no"} <= set(updates.columns) else ["line_id"])
    changed = [c for c in UPDATED if c in updates.columns]
    latest = updates.groupBy(*key).agg(F.max_by(F.struct(*changed), sequence).alias("_u"))

    def values(rows: DataFrame) -> DataFrame:
        kept = [c for c in UPDATED if c in rows.columns]
        return rows.join(latest, key).select(*_POSITION, *[
            F.coalesce(F.col(f"_u.{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in kept],
            F.lit(False).alias("_deleted"))

    return _write_overlay(spark, f"{base.rstrip('/')}/{record_type}", values, run)


def delete_rows(spark: SparkSession, base: str, record_type: str, condition: Column,
                start: date | None = None, end: date | None = None, run: str | None = None) -> list[date]:
    """Rows that meet a condition stop counting, by the same overlay; no day is written again."""
    def values(rows: DataFrame) -> DataFrame:
        kept = [c for c in UPDATED if c in rows.columns]
        return rows.where(condition).select(*_POSITION, *kept, F.lit(True).alias("_deleted"))

    return _write_overlay(spark, f"{base.rstrip('/')}/{record_type}", values, run, start, end)


def _write_overlay(spark: SparkSession, folder: str, values, run: str | None = None,
                   start: date | None = None, end: date | None = None) -> list[date]:
    now = G.ensured(spark, folder)
    name = f"run-{run}" if run else uuid.uuid4().hex
    if now.has_run(name):
        return []
    pairs = now.pairs(_between(start, end))
    marks = now.marks({d for _, d in pairs}.__contains__)
    days: list[str] = []
    if pairs:
        path = G.overlay_path(folder, name)
        rows = values(read_pairs(spark, folder, now, pairs, positions=True))
        rows.withColumn("_version", F.lit(now.number + 1)).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("date").parquet(path)
        days = G.days_below(spark, path)
    own = set(days)
    needed = {p for p in pairs if p[1] in own}
    G.commit(spark, folder, lambda g: G.replace(g.with_run(name), overlays={**g.overlays, name: days} if days else g.overlays),
             needs=needed, marks={m for m in marks if m[1] in own} if needed else None)
    return [date.fromisoformat(d) for d in sorted(days)]


def retain_days(df: DataFrame, days: int, as_of: datetime, ts: str = "received_at") -> DataFrame:
    """Rows of the last days."""
    return filters.time_window(df, as_of - timedelta(days=days), None, ts)


def expired_partitions(df: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Lake days that lie wholly before the cut and can be dropped as folders."""
    cut = (as_of - timedelta(days=days)).date()
    return df.select("date").where(F.col("date") < F.lit(cut)).distinct()


def drop_expired(spark: SparkSession, base: str, record_type: str, days: int, as_of: datetime,
                 rows: str | None = None) -> list[str]:
    """The days that lie wholly before the cut stop counting and are removed; returns their names.

    With ``rows``, a column of times, the rows of the day of the cut that are older go as well, by
    an overlay.
    """
    cut, folder = as_of - timedelta(days=days), f"{base.rstrip('/')}/{record_type}"
    day = cut.date().isoformat()
    now = G.ensured(spark, folder)
    old = now.pairs(lambda d: d < day)
    if old:
        G.commit(spark, folder, lambda g: g.without(g.pairs(lambda d: d < day), g.marks(lambda d: d < day)))
        G.purge(spark, folder)
    if rows is not None:
        delete_rows(spark, base, record_type, F.col(rows) < F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz"),
                    cut.date(), cut.date())
    return sorted({f"date={d}" for _, d in old})


# ------------------------------------------------------------------------------- reading
_POSITION = ["date", "_file", "_row"]
_NAME = r"/(date=[^/]+/.*)$"


def _between(start: date | None, end: date | None):
    """Whether a day's name lies between two days."""
    return lambda d: (start is None or d >= start.isoformat()) and (end is None or d <= end.isoformat())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, none if it does not exist."""
    files, where = G.store(spark, path)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory())


remove = G.remove


def read_type(spark: SparkSession, base: str, record_type: str, schema: str | None = None,
              start: date | None = None, end: date | None = None) -> DataFrame:
    """One type of the lake, files merged by column name, days pruned, updates applied.

    Only the folders of the chosen days are listed, and of these only what counts. With a schema
    nothing is inferred, which is the way for large lakes. Without one, files are merged by name;
    where they disagree on a type, the widest holds.
    """
    folder = f"{base.rstrip('/')}/{record_type}"
    now = G.current(spark, folder) or G.as_found(spark, folder)
    df = read_pairs(spark, folder, now, now.pairs(_between(start, end)), schema)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def read_pairs(spark: SparkSession, folder: str, now: G.Generation, pairs: set[tuple[str, str]],
               schema: str | None = None, positions: bool = False, files: set[str] = frozenset()) -> DataFrame:
    """Some (part, day) of a type, and single ``files`` below its folder, with their overlays;
    optionally with the place of every row (``_file``, ``_row``)."""
    of = {f: f[5:15] for f in files}
    marked = {d for _, d in now.marks({*of.values(), *(d for _, d in pairs)}.__contains__)}
    out = []
    for has_marks, direct in ((m, d) for m in (True, False) for d in (True, False)):
        # files directly below a day are named by a pattern, so that its parts are not read with them
        paths = [G.part_path(folder, p, d) + ("/*.parquet" if direct else "") for p, d in pairs
                 if (d in marked) == has_marks and (p == G.DIRECT) == direct]
        paths += [f"{folder}/{f}" for f, d in of.items() if (d in marked) == has_marks and ("/batch_id=" not in f) == direct]
        if not paths:
            continue
        place = positions or has_marks
        rows = footers.read_files(spark, folder, sorted(paths), schema, place=place)
        rows = rows.drop("batch_id")
        if "date" in rows.columns:
            rows = rows.withColumn("date", F.col("date").cast("date"))
        if place:
            rows = rows.withColumns({"_file": F.regexp_extract("_file", _NAME, 1)})
        if has_marks:
            rows = _overlaid(spark, folder, rows, now, marked)
        out.append(rows if positions else rows.drop("_file", "_row"))
    if not out:  # nothing chosen: the columns of any part, without rows
        some = next(iter(sorted(now.pairs())), None)
        if some is None:
            return spark.read.option("mergeSchema", True).parquet(folder)  # says what is missing
        return read_pairs(spark, folder, now, {some}, schema, positions).where("false")
    return out[0] if len(out) == 1 else unions.union_widening(out)


def _overlaid(spark: SparkSession, folder: str, rows: DataFrame, now: G.Generation, days: set[str]) -> DataFrame:
    """Rows with the newest overlay of their place; deleted ones go."""
    newest = None
    for name, of in now.overlays.items():
        paths = [G.overlay_path(folder, name, d) for d in of if d in days]
        if paths:
            part = spark.read.option("basePath", G.overlay_path(folder, name)).parquet(*paths).drop("date")
            newest = part if newest is None else newest.unionByName(part, allowMissingColumns=True)
    kept = [c for c in UPDATED if c in newest.columns and c in rows.columns]
    newest = newest.groupBy("_file", "_row").agg(F.max_by(F.struct("_deleted", *kept), "_version").alias("_now"))
    both = rows.join(newest, ["_file", "_row"], "left").where(~F.coalesce(F.col("_now._deleted"), F.lit(False)))
    return both.select(*[F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c)
                         if c in kept else F.col(c) for c in rows.columns])


def read_lake(spark: SparkSession, base: str, types: list[str], start: date | None = None,
              end: date | None = None, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """S3: chosen types between two days, a frame per type that exists."""
    present = set(lake_types(spark, base))
    return {t: read_type(spark, base, t, (schemas or {}).get(t), start, end)
            for t in types if t in present}


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of files; their content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def lake_files(spark: SparkSession, base: str) -> DataFrame:
    """Every finished file that counts, with its type and day."""
    files = list_files(spark, base, "*.parquet")
    named = files.select(
        F.regexp_extract("path", r"/([^/]+)/date=[^/]+/(?:batch_id=[^/]+/)?[^/]+$", 1).alias("record_type"),
        F.regexp_extract("path", r"/date=([^/]+)/", 1).alias("day"),
        F.regexp_extract("path", r"/batch_id=([^/]+)/", 1).alias("part"), "path", "length")
    counting, tabled = [], []
    for record_type in lake_types(spark, base):
        now = G.current(spark, f"{base.rstrip('/')}/{record_type}")
        if now is not None:
            tabled.append(record_type)
            counting += [(record_type, d, p) for p, d in now.pairs()]
    known = spark.createDataFrame(counting, "record_type string, day string, part string")
    free = named.where(~F.col("record_type").isin(tabled)) if tabled else named
    named = free.unionByName(named.join(known, ["record_type", "day", "part"], "left_semi"))
    return named.select(
        "record_type", F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day")).try_cast("date").alias("date"),
        "path", F.col("length").alias("bytes")).where("record_type <> ''")


def lake_inventory(spark: SparkSession, base: str) -> DataFrame:
    """Files and bytes per type and day."""
    return lake_files(spark, base).groupBy("record_type", "date").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def lake_types(spark: SparkSession, base: str) -> list[str]:
    """Types of a lake: the folders below it that hold days."""
    root = base.rstrip("/")
    return [n for n in folders(spark, root) if not n.startswith(("_", "."))
            and any(d.startswith("date=") for d in folders(spark, f"{root}/{n}"))]


def register_lake_views(spark: SparkSession, base: str, prefix: str = "view_",
                        schemas: dict[str, str] | None = None, types: list[str] | None = None,
                        start: date | None = None, end: date | None = None) -> list[str]:
    """A temporary view per lake type, all or the chosen ones, of all or the chosen days."""
    frames = read_lake(spark, base, types if types is not None else lake_types(spark, base), start, end, schemas)
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name.lower()}")
    return sorted(f"{prefix}{name.lower()}" for name in frames)


def stale_writes(spark: SparkSession, base: str, as_of: datetime) -> DataFrame:
    """Unfinished files by age; one whose finished twin exists is complete."""
    return file_ages(list_files(spark, base, UNFINISHED), list_files(spark, base, "*.parquet"), as_of)


def file_ages(unfinished: DataFrame, finished: DataFrame, as_of: datetime) -> DataFrame:
    """State of each unfinished file, from two file listings."""
    twins = finished.select(F.col("path").alias("final_path"), F.lit(True).alias("_done"))
    rows = unfinished.withColumn("final_path", F.regexp_replace("path", r"\.writing$", ""))
    rows = rows.join(twins, "final_path", "left")
    age = F.lit(as_of.timestamp()) - F.unix_micros("modificationTime") / 1e6
    return rows.select(
        "path", age.alias("age_seconds"),
        F.when(F.col("_done"), F.lit("completed"))
        .when(age >= FAULT_SECONDS, F.lit("fault_detected"))
        .when(age >= FIRST_RETRY_SECONDS, F.lit("waiting_second_retry"))
        .otherwise(F.lit("waiting_first_retry")).alias("status"))
