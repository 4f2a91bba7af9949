"""Projection, predicates and limits."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The look-back presets.
LOOK_BACK = {
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """the requested columns that exist; all columns where none of them does."""
    known = [c for c in columns or [] if c in df.columns]
    return df.select(*known) if known else df


def equals(df: DataFrame, filters: dict[str, Any] | None = None) -> DataFrame:
    """equality on every entry; None matches nothing, as in SQL."""
    for name, value in (filters or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def time_window(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None,
    ts: str = "received_at", partition: str = "date",
) -> DataFrame:
    """inclusive window.

    Lake frames carry the day of ``received_at`` as partition column; the same window on that
    column lets the scan skip whole days.
    """
    pruned = partition in df.columns and ts == "received_at" and dict(df.dtypes)[partition] == "date"
    if start is not None:
        df = df.where(F.col(ts) >= _ntz(start))
        df = df.where(F.col(partition) >= F.lit(start.date())) if pruned else df
    if end is not None:
        df = df.where(F.col(ts) <= _ntz(end))
        df = df.where(F.col(partition) <= F.lit(end.date())) if pruned else df
    return df


def _ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def look_back(
    df: DataFrame, time_range: str, as_of: datetime | None = None, ts: str = "received_at",
) -> DataFrame:
    """rows since a preset; any other text filters nothing."""
    span = LOOK_BACK.get(time_range)
    if span is None:
        return df
    return time_window(df, (as_of or datetime.now()) - span, None, ts)


def look_back_days(time_range: str, as_of: datetime | None = None) -> tuple[date | None, date | None]:
    """F4 as a pair of days, for lake reads."""
    span = LOOK_BACK.get(time_range)
    now = as_of or datetime.now()
    return ((now - span).date(), now.date()) if span else (None, None)


def contains_text(df: DataFrame, needles: dict[str, str]) -> DataFrame:
    """case-insensitive "contains"."""
    for name, needle in needles.items():
        df = df.where(F.lower(F.col(name).cast("string")).contains(needle.lower()))
    return df


def raw_line_query(
    raw: DataFrame, start: datetime | None = None, end: datetime | None = None,
    record_type: str | None = None, parse_status: str | None = None, limit: int | None = None,
    id_col: str = "line_id",
) -> DataFrame:
    """newest raw lines by time, type and status."""
    rows = equals(time_window(raw, start, end), _given(
        record_type=record_type, parse_status=parse_status))
    return first_rows(rows, "received_at", id_col, limit)


def error_query(
    errors: DataFrame, start: datetime | None = None, end: datetime | None = None,
    error_type: str | None = None, limit: int | None = None, id_col: str = "line_id",
) -> DataFrame:
    """newest error rows by time and type."""
    rows = equals(time_window(errors, start, end), _given(error_type=error_type))
    return first_rows(rows, "received_at", id_col, limit)


def _given(**values: Any) -> dict[str, Any]:
    return {k: v for k, v in values.items() if v}


def config_query(
    configs: DataFrame, head_id: str | None = None, sentence_type: str | None = None,
    start: datetime | None = None, end: datetime | None = None, limit: int | None = None,
) -> DataFrame:
    """F8: configurations (see ``unions.all_configurations``) by head, type and time."""
    rows = equals(time_window(configs, start, end), _given(
        head_id=head_id, sentence_type=sentence_type))
    return first_rows(rows, "received_at", "config_id", limit)


def present(df: DataFrame, *columns: str) -> DataFrame:
    """rows where every column has a value."""
    for name in columns:
        df = df.where(F.col(name).isNotNull())
    return df


def null_invalid(df: DataFrame, *columns: str, limit: float = -9.0) -> DataFrame:
    """values of ``limit`` or less mark missing measurements and become NULL."""
    return df.withColumns({c: F.when(F.col(c) > limit, F.col(c)) for c in columns})


def flag_invalid(df: DataFrame, column: str, limit: float = -9.0) -> DataFrame:
    """keep the value, add ``is_valid``."""
    return df.withColumn("is_valid", F.coalesce(F.col(column) > limit, F.lit(False)))


def on_day(df: DataFrame, day: date, ts: str = "received_at") -> DataFrame:
    """rows of one day, as a range so that file statistics apply."""
    start = datetime(day.year, day.month, day.day)
    return time_window(df, start, None, ts).where(F.col(ts) < _ntz(start + timedelta(days=1)))


def recent_count(df: DataFrame, minutes: int, as_of: datetime, ts: str = "received_at") -> DataFrame:
    """number of rows after ``as_of`` minus some minutes."""
    return df.where(F.col(ts) > _ntz(as_of - timedelta(minutes=minutes))).agg(
        F.count(F.lit(1)).alias("recent"))


# Documented measurement ranges (low, high, high inclusive).
RANGES = {
    "temperature": (-5.0, 50.0, True),
    "pressure": (0.0, 20000.0, True),
    "heading": (0.0, 360.0, False),
    "pitch": (-90.0, 90.0, True),
    "roll": (-180.0, 180.0, True),
    "battery": (0.0, 30.0, True),
    "sound_speed": (1400.0, 2000.0, True),
}


def validity_report(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """keep every row and list what is wrong with it.

    Adds ``validation_errors`` (texts, in rule order) and ``is_fully_valid``.  Rules apply to
    the columns the frame has: documented ranges, beams that suit the instrument, blanking
    below the covered range, coordinate name and code that agree.
    """
    have = set(df.columns)
    rules: list[Column] = []
    for name in required:
        rules.append(F.when(F.col(name).isNull(), F.lit(f"missing {name}")))
    for name, (low, high, inclusive) in RANGES.items():
        if name in have:
            c = F.col(name)
            wrong = (c < low) | ((c > high) if inclusive else (c >= high))
            rules.append(F.when(wrong, F.lit(f"{name} out of range")))
    if {"instrument_type_code", "beam_count"} <= have:
        code, beams = F.col("instrument_type_code"), F.col("beam_count")
        wrong = ((code == 4) & (beams != 4)) | (code.isin(0, 2) & ~beams.between(1, 3))
        rules.append(F.when(wrong, F.lit("beam_count does not suit the instrument")))
    if {"blanking_distance", "cell_size", "cell_count"} <= have:
        wrong = F.col("blanking_distance") >= F.col("cell_size") * F.col("cell_count")
        rules.append(F.when(wrong, F.lit("blanking_distance beyond the covered range")))
    if {"coord_system_name", "coord_system_code"} <= have:
        pairs = {"ENU": 0, "XYZ": 1, "BEAM": 2}
        right = F.lit(False)
        for text, code in pairs.items():
            right = right | ((F.col("coord_system_name") == text)
                             & (F.col("coord_system_code") == code))
        rules.append(F.when(~right, F.lit("coordinate name and code differ")))
    problems = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return df.withColumn("validation_errors", problems).withColumn(
        "is_fully_valid", F.size("validation_errors") == 0)


def format_label(data_format: Column | str = "data_format") -> Column:
    """DF100 ... DF104."""
    c = F.col(data_format) if isinstance(data_format, str) else data_format
    return F.concat(F.lit("DF"), c.cast("string"))


def config_label(data_format: Column | str = "data_format") -> Column:
    """sentence type of a configuration row."""
    c = F.col(data_format) if isinstance(data_format, str) else data_format
    return (F.when(c == 100, F.lit("PNORI")).when(c == 101, F.lit("PNORI1"))
            .otherwise(F.lit("PNORI2")))


def first_rows(
    df: DataFrame, by: str, tie: str | list[str], limit: int | None = None, descending: bool = True,
) -> DataFrame:
    """K1, K3: rows in a total order, NULLs last; with a limit, the first of them.

    A limit becomes a top-k in every task before the rows meet; without one all rows come back
    in order, by a range-partitioned sort.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    ordered = df.orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
                           for c in (by, *ties)])
    return ordered if limit is None else ordered.limit(limit)


def query(
    df: DataFrame, columns: list[str] | None = None, limit: int | None = None, order_by: str | None = None,
    descending: bool = True, tie: str = "record_id", ts: str | None = "received_at",
) -> DataFrame:
    """K2: columns, order column, direction, limit; the order column has to exist."""
    by = order_by or (ts if ts and ts in df.columns else tie)
    if by not in df.columns:
        raise ValueError(f"unknown order column {by!r}")
    return project(first_rows(df, by, tie, limit, descending), columns)


def query_data(
    df: DataFrame, columns: list[str] | None = None, filters: dict[str, Any] | None = None,
    start: datetime | None = None, end: datetime | None = None, limit: int | None = None,
    descending: bool = True, ts: str = "received_at", tie: str = "record_id",
    search: dict[str, str] | None = None,
) -> DataFrame:
    """F1-F5 and K1 in one call.  The text search comes before the limit, so it finds every row."""
    rows = time_window(equals(df, filters), start, end, ts)
    if search:
        rows = contains_text(rows, search)
    return project(first_rows(rows, ts, tie, limit, descending), columns)


def time_series(
    df: DataFrame, y_columns: list[str], time_range: str = "all", as_of: datetime | None = None,
    x_column: str | None = None, ts: str = "received_at", tie: str = "record_id",
    limit: int | None = None,
) -> DataFrame:
    """K3: x and y columns, oldest first; all of them, unless a look-back is asked for."""
    x = x_column or ts
    rows = first_rows(look_back(df, time_range, as_of, ts), x, tie, limit, descending=False)
    return rows.select(x, *[c for c in y_columns if c in df.columns])


def multi_series(series: list[tuple[str, DataFrame, str]], x: str = "received_at") -> DataFrame:
    """K3: several labelled series, of one or several sources, as (label, x, y) rows."""
    out = None
    for label, df, y in series:
        part = df.select(F.lit(label).alias("label"), F.col(x).alias("x"),
                         F.col(y).cast("double").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def time_then_cell(df: DataFrame, limit: int, ts: str = "received_at", cell: str = "cell_index",
                   tie: str = "record_id") -> DataFrame:
    """K4: newest burst first, cells upwards within it."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(cell).asc_nulls_last(),
                      F.col(tie).asc_nulls_last()).limit(limit)


def some_rows(df: DataFrame, limit: int | None = None, tie: str = "record_id") -> DataFrame:
    """K5: some rows of one table, lowest ids first so that the answer repeats."""
    return df.orderBy(F.col(tie).asc_nulls_last()).limit(limit)
