"""Set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelake.operators import filters

CONFIG_COLUMNS = (
    "config_id", "received_at", "sentence_type", "original_sentence", "instrument_type_name",
    "instrument_type_code", "head_id", "beam_count", "cell_count", "blanking_distance",
    "cell_size", "coord_system_name", "coord_system_code", "checksum",
)


def all_configurations(pnori: DataFrame, pnori12: DataFrame) -> DataFrame:
    """Both configuration tables with the sentence type they came from."""
    left = pnori.withColumn("sentence_type", F.lit("PNORI"))
    right = pnori12.withColumn("sentence_type", filters.config_label("data_format"))
    keep = [c for c in CONFIG_COLUMNS if c in left.columns and c in right.columns]
    return left.select(*keep).unionByName(right.select(*keep))


def all_sensors(df100: DataFrame, df12: DataFrame, df34: DataFrame, limit: int | None = None,
                tie: str = "record_id") -> DataFrame:
    """Sensor rows of the three tables with a format label, newest first."""
    keep = ("heading", "pitch", "roll", "pressure", "temperature")
    parts = [_labelled(df100, keep, 100, tie), _labelled(df12, keep, None, tie),
             _labelled(df34, keep, None, tie)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return filters.first_rows(out, "received_at", tie, limit)


def all_velocities(df100: DataFrame, df12: DataFrame, limit: int | None = None,
                   tie: str = "record_id") -> DataFrame:
    """Velocity cells of the profile formats; averaged formats are no profiles."""
    keep = ("cell_index", "vel1", "vel2", "vel3", "vel4")
    out = _labelled(df100, keep, 100, tie).unionByName(_labelled(df12, keep, None, tie))
    return filters.first_rows(out, "received_at", [tie, "cell_index"], limit)


def headers(pnorh: DataFrame, limit: int | None = None, tie: str = "record_id") -> DataFrame:
    """U4: header rows with a format label, newest first."""
    return filters.first_rows(
        _labelled(pnorh, ("error_code", "status_code"), None, tie), "received_at", tie, limit)


def _labelled(df: DataFrame, keep: tuple[str, ...], fixed: int | None, tie: str) -> DataFrame:
    fmt = F.lit(f"DF{fixed}") if fixed else filters.format_label("data_format")
    return df.select(tie, "received_at", fmt.alias("format"), *keep)


def bursts(df: DataFrame, start: datetime | None = None, end: datetime | None = None,
           limit: int | None = None, ts: str = "received_at") -> DataFrame:
    """Distinct bursts in a window, newest first, with a label; per stream where it is known."""
    stream = ["stream_id"] if "stream_id" in df.columns else []
    rows = filters.time_window(df, start, end, ts).select(
        *stream, "measurement_date", "measurement_time", ts).distinct()
    rows = rows.withColumn("label", F.concat_ws(
        " ", F.coalesce("measurement_date", F.lit("None")),
        F.coalesce("measurement_time", F.lit("None"))))
    return filters.first_rows(rows, ts, ["measurement_date", "measurement_time", *stream], limit)


# Order of widening for columns whose type differs between files.
_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 5, "double": 6}


def wider_type(a: str, b: str) -> str:
    """Common type of two column types, text where numbers do not cover both."""
    if a == b:
        return a
    if a in _RANK and b in _RANK:
        return max(a, b, key=_RANK.__getitem__) if not {a, b} == {"bigint", "float"} else "double"
    if a.startswith("decimal") and b.startswith("decimal"):
        (p1, s1), (p2, s2) = (map(int, t[8:-1].split(",")) for t in (a, b))
        scale = max(s1, s2)
        return f"decimal({min(38, max(p1 - s1, p2 - s2) + scale)},{scale})"
    if (a in _RANK or a.startswith("decimal")) and (b in _RANK or b.startswith("decimal")):
        return "double"
    if {a, b} == {"date", "timestamp_ntz"}:
        return "timestamp_ntz"
    if "void" in (a, b):
        return b if a == "void" else a
    return "string"


def union_widening(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns become NULL, differing types are widened first."""
    types: dict[str, str] = {}
    for df in frames:
        for name, dtype in df.dtypes:
            types[name] = wider_type(types.get(name, dtype), dtype)
    out = None
    for df in frames:
        have = dict(df.dtypes)
        df = df.select(*[F.col(n) if have[n] == types[n] else F.col(n).cast(types[n]).alias(n)
                         for n in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
