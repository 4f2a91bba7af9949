"""Line log to lake: parse once into a written table, then fill every output from it."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelake import layouts as L
from brinelake.functions import sentences as S
from brinelake.operators import scans
from brinelake.plans import parse
from brinelake.sources import lake
from brinelake.sources.lines import LINE_CHUNK, LINE_ORDER

BLOB_TEXT = "<BINARY_BLOB>"
STREAM = ["stream_id"]


def is_blob_line(text: str = "_text"):
    """Binary or undecodable: both belong to a blob."""
    return S.is_binary(text) | S.has_non_ascii(text)


def filled_lines(lines: DataFrame, line: str = "raw_sentence") -> DataFrame:
    """Lines with one character per byte in ``_text``; blank ones neither count nor end a run."""
    rows = lines.withColumn("_text", S.one_char_per_byte(line))
    return rows.where(is_blob_line() | (S.strip("_text") != ""))


def blob_rows(index: DataFrame) -> DataFrame:
    """One rejected row per blob, in the shape of ``parse_lines``."""
    return index.select(
        *STREAM, *[c for c in ("received_at", "line_id") if c in index.columns],
        F.lit(BLOB_TEXT).alias("raw_sentence"), F.lit(None).cast("string").alias("record_type"),
        F.lit("FAIL").alias("parse_status"), F.lit("BINARY_DATA").alias("error_type"),
        F.lit("Binary blob captured").alias("error_message"))


def with_headers(parsed: DataFrame, chunk: list[str], order: list[str],
                 initial: DataFrame | None = None) -> DataFrame:
    """W1 on a parsed frame: only the averaged formats go through the ordered scan.

    Lines before the first header of their stream have no time and become
    CONSTRAINT_VIOLATION rows.
    """
    averaged = F.coalesce(F.col("table_name").isin("pnorh", "pnors34", "pnorc34"), F.lit(False))
    done = scans.attach_headers(parsed.where(averaged), STREAM, chunk, order, initial=initial)
    lost = (F.col("record_type").isin(*scans.CARRIED_TYPES) & (F.col("parse_status") == "OK")
            & F.col("carried_date").isNull())
    done = done.withColumns({
        "error_type": F.when(lost, F.lit("CONSTRAINT_VIOLATION")).otherwise(F.col("error_type")),
        "error_message": F.when(lost, F.lit("No header before the line"))
        .otherwise(F.col("error_message")),
        "checksum_valid": F.when(~F.coalesce(lost, F.lit(False)), F.col("checksum_valid")),
        "parse_status": F.when(lost, F.lit("FAIL")).otherwise(F.col("parse_status"))})
    return done.unionByName(parsed.where(~averaged), allowMissingColumns=True)


def stage(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a frame once and go on from the written table.

    Every output reads it instead of parsing again, and a lost executor costs nothing that
    was parsed before.  ``by`` keeps the rows of each table in a folder of their own.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def present_tables(staged: DataFrame) -> set[str]:
    """Tables with accepted rows; at most as many names as there are layouts."""
    rows = staged.where("parse_status = 'OK' AND table_name IS NOT NULL").select(
        "table_name").distinct()
    return {r.table_name for r in rows.toLocalIterator()}


def outputs(parsed: DataFrame, only: set[str] | None = None) -> dict[str, DataFrame]:
    """A1-A3: raw lines, errors and typed tables of one (staged) parsed frame."""
    typed = {t: parse.typed_table(parsed, t) for t in L.tables() if only is None or t in only}
    return {"raw_lines": parse.raw_lines(parsed), "parse_errors": parse.parse_errors(parsed), **typed}


def dated(parsed: DataFrame, staging: str, blobs: DataFrame | None = None,
          initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Parsed (staged) lines with carried headers, staged by table; and the averaged-format rows among
    them, if there are any, from which the header state is taken. Without any of these, and
    without blobs to add, the parsed lines stand as they are."""
    averaged_tables = [t for t in L.tables() if t in ("pnorh", "pnors34", "pnorc34")]
    averaged = parsed.where(F.col("table_name").isin(averaged_tables))
    has_averaged = not averaged.isEmpty()
    if not has_averaged and blobs is None:
        return parsed, None
    out = with_headers(parsed, LINE_CHUNK, LINE_ORDER, initial) if has_averaged else parsed
    if blobs is not None:
        out = out.unionByName(blobs, allowMissingColumns=True)
    staged = stage(out, staging, by="table_name")
    return staged, staged.where(F.col("table_name").isin(averaged_tables)) if has_averaged else None


#: Outputs that are written at a time. Each is a job of its own over one staged read; small types
#: do not fill a cluster one after the other.
WRITERS = 8


def write_all(tables: dict[str, DataFrame], base: str, run: str) -> None:
    """Every output under one run, several jobs at a time; the first failure is raised."""
    def write(name: str, df: DataFrame) -> None:
        lake.write_run(df, base, L.LAKE_TYPES.get(name, name.upper()), run)

    with ThreadPoolExecutor(WRITERS) as pool:
        for job in [pool.submit(write, name, df) for name, df in tables.items()]:
            job.result()


def ingest(lines: DataFrame, base: str, staging: str, strict: bool = False,
           assemble_blobs: bool = False, run: str | None = None) -> dict[str, DataFrame]:
    """Numbered lines (``sources.lines.number_lines``) into the lake; returns what was written.

    Everything is written under the id of the run, as a stream writes under its batch: running
    again with the same id, after a crash or by mistake, replaces what that run wrote before and
    touches nothing else. Without an id every call is a run of its own.
    """
    run = run or uuid.uuid4().hex
    staging = f"{staging.rstrip('/')}/run={run}"
    blobs = None
    if assemble_blobs:
        lines = stage(lines, f"{staging}/lines")
        rows = filled_lines(lines)
        member = is_blob_line()
        parts = scans.blob_parts(rows, "raw_sentence", member, STREAM, LINE_CHUNK, LINE_ORDER)
        lake.write_run(parts.withColumn("received_at", F.col("started_at")), base, "BLOBS", run)
        index = scans.blob_index(rows, "raw_sentence", member, STREAM, LINE_CHUNK, LINE_ORDER)
        blobs = blob_rows(index.withColumn("received_at", F.col("started_at")))
        lines = rows.where(~member).drop("_text")
    parsed = stage(parse.parse_lines(lines, strict=strict), f"{staging.rstrip('/')}/parsed",
                   by="table_name")
    staged, _ = dated(parsed, f"{staging.rstrip('/')}/dated", blobs)
    tables = outputs(staged, present_tables(staged))
    write_all(tables, base, run)
    return tables
