"""Reading files that do not agree on their columns (S3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.operators import unions

_FACTS = "path string, place int, name string, type string"


def schema_facts(files: DataFrame) -> DataFrame:
    """(path, place, name, type): the columns of every file, from footers that tasks read.

    ``files`` has ``path``. A task opens the ends of its files only.
    """
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                where = path if "://" in path else path.replace("file:", "", 1)
                files, name = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
                with files.open_input_file(name) as source:
                    kind = from_arrow_schema(pq.read_schema(source).remove_metadata(), prefer_timestamp_ntz=True)
                rows += [(path, k, f.name, f.dataType.simpleString()) for k, f in enumerate(kind.fields)]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "place", "name", "type"), r)) for r in rows], schema=pa.schema(
                [("path", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("type", pa.string())]))

    return files.select("path").mapInArrow(told, _FACTS)


def merged_schema(facts: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(name, widest type, types) of the columns of all files, in order of their first place.

    Types are widened two by two in any order; there are few of them per column, whatever the
    number of files, and only they come to the driver.
    """
    seen = (facts.groupBy("name", "type").agg(F.min("place").alias("place")).groupBy("name")
            .agg(F.min("place").alias("place"), F.sort_array(F.collect_list("type")).alias("types")))
    out = []
    for row in seen.orderBy("place", "name").collect():
        widest = row.types[0]
        for t in row.types[1:]:
            widest = unions.wider_type(widest, t)
        out.append((row.name, widest, list(row.types)))
    return out


def _scanned(spark: SparkSession, folder: str, paths: list[str], schema, place: bool) -> DataFrame:
    reader = spark.read.option("basePath", folder).option("pathGlobFilter", "*.parquet")
    df = (reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)).parquet(*paths)
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.row_index").alias("_row")) if place else df


def read_files(spark: SparkSession, folder: str, paths: list[str], schema: str | None = None,
               place: bool = False) -> DataFrame:
    """Files below a folder, merged by name; ``place`` adds ``_file`` and ``_row`` of every row.

    Where files disagree on a column's type, the footers are read by tasks, and files that agree on
    those columns are read together and widened. There are as many such groups as combinations
    of types, not of files.
    """
    try:
        return _scanned(spark, folder, paths, schema, place)
    except Exception as error:  # noqa: BLE001 - only a failed merge is handled
        if schema is not None or "MERGE_SCHEMA" not in str(error):
            raise
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(paths).select("path").repartition(spark.sparkContext.defaultParallelism)
    facts = schema_facts(files).persist()
    try:
        disputed = [name for name, _, types in merged_schema(facts) if len(types) > 1]
        kinds = (facts.where(F.col("name").isin(disputed)).groupBy("path")
                 .agg(F.sort_array(F.collect_list(F.struct("name", "type"))).alias("kind")))
        kinds = files.join(kinds, "path", "left").groupBy("kind").agg(F.collect_list("path").alias("paths"))
        groups = [row.paths for row in kinds.collect()]
    finally:
        facts.unpersist()
    return unions.union_widening([_scanned(spark, folder, group, None, place) for group in groups])
