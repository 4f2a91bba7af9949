"""Line files as batch and stream."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Chunk and order of numbered lines, for the ordered scans.
LINE_CHUNK = ["file_path", "block_start", "segment"]
LINE_ORDER = ["line_in_block"]
# Places per segment: what one task orders, however large a split or an unsplittable file is.
SEGMENT_LINES = 1 << 16
# Splits of a session that asks for small ones are read in runs of about so many bytes by one task.
TASK_BYTES = 1 << 20


def _with_origin(lines: DataFrame, stream: Column | None) -> DataFrame:
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return lines.select(
        F.col("value").alias("raw_sentence"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
    ).withColumn("stream_id", folder if stream is None else stream)


def read_lines(spark: SparkSession, path: str | list[str], stream: Column | None = None,
               pattern: str = "*.nmea") -> DataFrame:
    """One row per line with its file, the start of its split, and a place in the split.

    ``line_place`` grows with the line order inside a file split.  ``stream_id`` is the folder
    of the file unless ``stream`` (an expression on ``file_path``) says otherwise.
    """
    lines = spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).text(path)
    splits_a_task = TASK_BYTES // _split_bytes(spark)
    if splits_a_task > 1:
        lines = _with_origin(lines, stream)
        lines = lines.coalesce(max(1, lines.rdd.getNumPartitions() // splits_a_task))
        return lines.withColumn("line_place", F.monotonically_increasing_id())
    return _with_origin(lines, stream).withColumn("line_place", F.monotonically_increasing_id())


def _split_bytes(spark: SparkSession) -> int:
    """The session's largest file split."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return max(1, int(number) << 10 * " kmgtp".index(unit or " "))


def stream_lines(spark: SparkSession, path: str, stream: Column | None = None,
                 max_files: int = 1000, pattern: str = "*.nmea") -> DataFrame:
    """The same rows from a growing folder; ``max_files`` per batch bounds the work."""
    lines = spark.readStream.option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).text(path)
    return _with_origin(lines, stream)


def number_lines(lines: DataFrame, place: str = "line_place", segment: int = SEGMENT_LINES) -> DataFrame:
    """A1: ``segment``, ``line_in_block``, ``line_no`` in the file, and the repeatable ``line_id``.

    Lines are counted on two levels: a split is cut into segments of places, rows are numbered
    inside each, and running sums over one row per segment give the number in the split and in
    the file. ``line_no`` does not depend on where splits or segments begin, so (``file_path``,
    ``line_no``) names a line for good; ``line_id`` is a hash of the two for use as one column.
    The lines are shuffled once, by segment, which the ordered scans then use as well; so a file
    that cannot be split (gzip) is read by one task and ordered by many.
    """
    lines = lines.drop("segment", "line_in_block", "line_no", "line_id")
    if place not in lines.columns:
        lines = lines.withColumn(place, F.monotonically_increasing_id())
    lines = lines.withColumn("segment", F.floor(F.col(place) / segment))
    inside = Window.partitionBy(*LINE_CHUNK).orderBy(place)
    numbered = lines.withColumn("_k", F.row_number().over(inside)).drop(place)
    per_segment = lines.groupBy(*LINE_CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    # one row per segment
    of_split = Window.partitionBy("file_path", "block_start").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file_path").orderBy("block_start", "segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_segment.select(*LINE_CHUNK, F.coalesce(F.sum("_n").over(of_split), F.lit(0)).alias("_split"),
                                 F.coalesce(F.sum("_n").over(of_file), F.lit(0)).alias("_file"))
    numbered = numbered.join(offsets, LINE_CHUNK).withColumns({
        "line_in_block": (F.col("_split") + F.col("_k")).cast("int"), "line_no": F.col("_file") + F.col("_k")})
    numbered = numbered.select(*lines.drop(place, "segment").columns, "segment", "line_in_block", "line_no")
    return numbered.withColumn("line_id", F.xxhash64("file_path", "line_no"))
