"""Depth profiles and cell grids (D4-D6, D13, G14's grid)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.operators import scans
from brinelake.operators.aggregates import of_stream

VELOCITIES = ("vel1", "vel2", "vel3", "vel4")


def depth(blanking: Column | float = 0.5, cell_size: Column | float = 1.0,
          distance: Column | None = None) -> Column:
    """Measured distance where there is one, otherwise blanking plus cells."""
    b = blanking if isinstance(blanking, Column) else F.lit(float(blanking))
    s = cell_size if isinstance(cell_size, Column) else F.lit(float(cell_size))
    computed = b + F.col("cell_index") * s
    return computed if distance is None else F.coalesce(distance.cast("double"), computed)


def velocity_profiles(
    cells: DataFrame, velocity_columns: list[str] | None = None, cell_size: float = 1.0,
    blanking: float = 0.5, timestamps: list[datetime] | None = None, ts: str = "measured_at",
) -> DataFrame:
    """Depth and components by cell of the given bursts, or of the latest one; where cells
    have a stream, of every stream.

    All bursts come from one job.
    """
    stream = of_stream(cells)
    columns = [c for c in velocity_columns or VELOCITIES if c in cells.columns]
    if timestamps:
        wanted = [F.lit(t.replace(microsecond=0).isoformat(sep=" ")).cast("timestamp_ntz")
                  for t in timestamps]
        rows = cells.where(F.col(ts).isin(*wanted))
    else:
        rows = scans.latest_burst(cells, ts, per_stream=bool(stream))
    distance = F.col("cell_distance") if "cell_distance" in cells.columns else None
    return rows.select(*stream, ts, "cell_index", depth(blanking, cell_size, distance).alias("depth"),
                       *columns).orderBy(*stream, ts, "cell_index")


def configured_profiles(
    cells: DataFrame, configs: DataFrame, stream: list[str], ts: str = "received_at",
    config_ts: str = "received_at",
) -> DataFrame:
    """Depth from the instrument's own configuration, the last one before the burst.

    The time-ordered part works on one row per burst; the many cells of a burst then join
    their burst on its key.
    """
    bursts = cells.select(*stream, ts).distinct()
    known = scans.as_of_join(bursts, configs, stream, ts, config_ts,
                             ["blanking_distance", "cell_size"])
    known = known.select(*stream, ts, F.col("blanking_distance").cast("double").alias("_b"),
                         F.col("cell_size").cast("double").alias("_s"))
    rows = cells.join(known, [*stream, ts], "left")
    distance = F.col("cell_distance") if "cell_distance" in cells.columns else None
    return rows.select(*cells.columns, depth(F.col("_b"), F.col("_s"), distance).alias("depth")
                       )


def amplitude_grid(cells: DataFrame, times: list[datetime], ts: str = "received_at",
                   value: str = "avg_amp") -> DataFrame:
    """Streams and their cells down, chosen times across, NULL where nothing was measured.

    The columns are the times asked for, so the width is the caller's and needs no first pass.
    """
    down = [*of_stream(cells), "cell_index"]
    out = cells.groupBy(*down)
    columns = [F.max(F.when(F.col(ts) == F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz"),
                            F.col(value))).alias(f"t{i}") for i, t in enumerate(times)]
    return out.agg(*columns).orderBy(*down)
