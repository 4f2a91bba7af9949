"""Metadata (C1-C6) and SQL functions (V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake import layouts as L

_COLUMNS = ("source string, column_name string, position int, column_type string, "
            "nullable boolean, unit string")


def column_class(data_type: T.DataType) -> str:
    """Class of a column by its type, not by the spelling of the type's name."""
    if isinstance(data_type, T.NumericType):
        return "NUMERIC"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    if isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "JSON"
    return "TEXT"


# Fixed value: words up to this length are abbreviations in a display name.
_ABBREVIATION = 2


def display_name(name: str) -> str:
    """A table name for people: its parts as capitalised words, abbreviations in capitals."""
    shown = []
    for part in filter(None, name.split("_")):
        shown.append(part.title() if len(part) > _ABBREVIATION else part.upper())
    return " ".join(shown)


def describe(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Class, nullability and unit of every column."""
    rows = [(name, f.name, i, column_class(f.dataType), f.nullable, L.UNITS.get(f.name))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, _COLUMNS)


def time_column(df: DataFrame) -> str:
    """The first timestamp column, ``received_at`` where there is none."""
    return next((f.name for f in df.schema.fields if column_class(f.dataType) == "TIMESTAMP"),
                "received_at")


def sources(spark: SparkSession, tables: dict[str, DataFrame] | None = None,
            with_counts: bool = True) -> DataFrame:
    """Tables with category, column count, time column and row count.

    Without ``tables`` the session's catalog is listed; names starting with ``_`` are hidden.
    """
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    out = None
    for name, df in sorted(tables.items()):
        if name.startswith("_"):
            continue
        one = df.agg(F.count(F.lit(1)).alias("record_count")) if with_counts else (
            spark.range(1).select(F.lit(None).cast("bigint").alias("record_count")))
        has_time = any(column_class(f.dataType) == "TIMESTAMP" for f in df.schema.fields)
        one = one.select(
            F.lit(name).alias("source"), F.lit(display_name(name)).alias("display_name"),
            F.lit(L.CATEGORIES.get(name, "Other")).alias("category"),
            F.lit(len(df.columns)).alias("column_count"), F.lit(has_time).alias("has_timestamp"),
            F.lit(time_column(df)).alias("time_column"), "record_count")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame(
        [], "source string, display_name string, category string, column_count int, "
            "has_timestamp boolean, time_column string, record_count bigint")


def columns(df: DataFrame) -> list[tuple[str, str]]:
    """C5."""
    return df.dtypes


def resolve(name: str, loaded: set[str], prefix: str = "pq_") -> str | None:
    """C4: the loaded view that shows a table.

    The layouts say which lake type holds a table; the views of that type, of the table's own
    name, and of the plain type that it is a variant of are looked for, nearest first.
    """
    if name in loaded:
        return name
    table = name.lower()
    lake_type = L.LAKE_TYPES.get(table, table.split("_")[0]).lower()
    plain = max((t.lower() for t in L.LAKE_TYPES.values()
                 if t.isalpha() and lake_type.startswith(t.lower())), key=len, default=lake_type)
    for view in (lake_type, table, plain):
        if f"{prefix}{view}" in loaded:
            return f"{prefix}{view}"
    return None


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Free SQL over registered tables; errors are raised."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


# V2: the checksum functions for SQL users, as SQL bodies.
_SQL_FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION nmea_checksum(line STRING) RETURNS STRING
    RETURN lpad(hex(aggregate(split(regexp_replace(substring_index(line, '*', 1), '^[$]', ''), ''),
      0, (acc, c) -> acc ^ ascii(c))), 2, '0')""",
    """CREATE OR REPLACE TEMPORARY FUNCTION nmea_checksum_ok(line STRING) RETURNS BOOLEAN
    RETURN CASE WHEN contains(line, '*')
      THEN nmea_checksum(line) = upper(trim(substring_index(line, '*', -1))) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION nmea_type(line STRING) RETURNS STRING
    RETURN substring(line, 2, instr(line, ',') - 2)""",
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """V2: ``nmea_checksum``, ``nmea_checksum_ok`` and ``nmea_type`` for SQL."""
    for statement in _SQL_FUNCTIONS:
        spark.sql(statement)
    return ["nmea_checksum", "nmea_checksum_ok", "nmea_type"]


# V2: table functions for SQL users; the views that they read are named when they are registered.
_TABLE_FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION sensor_buckets(stream STRING, minutes INT)
    RETURNS TABLE (bucket TIMESTAMP_NTZ, readings BIGINT, mean_temperature DOUBLE, mean_pressure DOUBLE)
    RETURN SELECT TIMESTAMP_NTZ'2000-01-03 00:00:00' + make_dt_interval(0, 0, CAST(width * b AS INT)), count(*),
      avg(CAST(temperature AS DOUBLE)), avg(CAST(pressure AS DOUBLE))
    FROM (SELECT *, floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-03 00:00:00', received_at) / (60000000L * width)) AS b
          FROM (SELECT *, explode(array({widths})) AS width FROM {sensors}))
    WHERE CAST(stream_id AS STRING) = stream AND width = minutes GROUP BY width, b""",
    """CREATE OR REPLACE TEMPORARY FUNCTION velocity_profile(stream STRING, at TIMESTAMP_NTZ, blanking DOUBLE, cell_size DOUBLE)
    RETURNS TABLE (cell_index INT, depth DOUBLE, vel1 DOUBLE, vel2 DOUBLE, vel3 DOUBLE)
    RETURN SELECT CAST(cell_index AS INT), coalesce(CAST(cell_distance AS DOUBLE), blanking + cell_index * cell_size),
      CAST(vel1 AS DOUBLE), CAST(vel2 AS DOUBLE), CAST(vel3 AS DOUBLE)
    FROM {cells} WHERE CAST(stream_id AS STRING) = stream AND measured_at = at""",
)


def register_table_functions(spark: SparkSession, sensors: str, cells: str,
                             widths: tuple[int, ...] = (1, 5, 10, 15, 30, 60)) -> list[str]:
    """V2: ``sensor_buckets(stream, minutes)`` and ``velocity_profile(stream, at, blanking, cell_size)``
    over the named views; they take columns of other tables as arguments after LATERAL.

    An argument can only choose rows, so the bucket widths that can be asked for are named here.
    """
    for statement in _TABLE_FUNCTIONS:
        spark.sql(statement.format(sensors=sensors, cells=cells, widths=", ".join(map(str, widths))))
    return ["sensor_buckets", "velocity_profile"]
