"""Burst-level joins.

Every join is an equi-join on the burst key and is left to the optimizer: sides below the
broadcast threshold are broadcast, larger ones are sorted and merged, and the adaptive skew
join splits a burst that holds an outsized share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BURST = ["measurement_date", "measurement_time"]


def burst_key(*frames: DataFrame) -> list[str]:
    """One integer where every side has it, otherwise date and time.

    Stream and data format belong to the key wherever all sides carry them: the instruments of a
    fleet sample at the same second.
    """
    shared = set.intersection(*[set(f.columns) for f in frames])
    key = ["measurement_id"] if "measurement_id" in shared else list(BURST)
    return [c for c in ("stream_id",) if c in shared] + key + (
        ["data_format"] if "data_format" in shared else [])


def _right(df: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """Key and wanted columns of a right side, under their new names."""
    return df.select(*key, *[F.col(c).alias(n) for c, n in columns.items() if c in df.columns])


ENERGY = {"energy_densities": "energy_densities", "start_frequency": "energy_start_freq",
          "step_frequency": "energy_step_freq", "num_frequencies": "energy_num_freq"}
BAND = {"hmo": "band_hm0", "tp": "band_tp", "main_dir": "band_main_dir"}
COEFFICIENT = {"coefficients": "coefficients", "coefficient_flag": "coefficient_flag"}
DIRECTION = {"values": "directional_values", "direction_type": "direction_type"}

WAVE_COLUMNS = ("record_id", "received_at", "measurement_date", "measurement_time",
                "spectrum_basis", "processing_method", "hm0", "h3", "h10", "hmax", "tm02", "tp",
                "tz", "dir_tp", "spr_tp", "main_dir", "wave_error_code")
WAVE_FULL_COLUMNS = ("record_id", "received_at", "measurement_date", "measurement_time",
                     "spectrum_basis", "hm0", "tp", "main_dir")
SENSOR_COLUMNS = ("heading", "pitch", "roll", "pressure", "temperature")


def _left(df: DataFrame, columns: tuple[str, ...] | None, key: list[str]) -> DataFrame:
    if columns is None:  # lake views carry every left column
        return df
    wanted = [c for c in columns if c in df.columns]
    return df.select(*wanted, *[k for k in key if k not in wanted])


def wave_measurement(waves: DataFrame, energy: DataFrame, all_columns: bool = False) -> DataFrame:
    """Wave parameters with the energy spectrum of their burst, if there is one."""
    key = burst_key(waves, energy)
    left = _left(waves, None if all_columns else WAVE_COLUMNS, key)
    return left.join(_right(energy, key, ENERGY), key, "left")


def wave_measurement_full(
    waves: DataFrame, energy: DataFrame, bands: DataFrame, coefficients: DataFrame,
    directions: DataFrame, all_columns: bool = False,
) -> DataFrame:
    """One row per combination of band, coefficient and direction row of a burst."""
    key = burst_key(waves, energy, bands, coefficients, directions)
    out = _left(waves, None if all_columns else WAVE_FULL_COLUMNS, key)
    energy_columns = {k: v for k, v in ENERGY.items() if k != "num_frequencies"}
    for side, columns in ((energy, energy_columns), (bands, BAND), (coefficients, COEFFICIENT),
                          (directions, DIRECTION)):
        out = out.join(_right(side, key, columns), key, "left")
    return out


def wave_bursts(
    waves: DataFrame, energy: DataFrame, coefficients: DataFrame, directions: DataFrame,
) -> DataFrame:
    """One row per wave row, the burst's arrays as columns A1, B1, A2, B2, MD and DS.

    The arrays are reduced to one row per burst before the join, so nothing fans out.  Of
    repeated rows the one with the lowest id counts.
    """
    key = burst_key(waves, energy, coefficients, directions)
    c = one_per_burst(coefficients, key, "coefficient_flag", "coefficients",
                      ("A1", "B1", "A2", "B2"))
    d = one_per_burst(directions, key, "direction_type", "values", ("MD", "DS"))
    e = energy.groupBy(*key).agg(F.min_by(F.struct(*ENERGY), "record_id").alias("_e")).select(
        *key, *[F.col(f"_e.{c}").alias(n) for c, n in ENERGY.items()])
    left = _left(waves, WAVE_FULL_COLUMNS, key)
    return left.join(e, key, "left").join(c, key, "left").join(d, key, "left")


def one_per_burst(df: DataFrame, key: list[str], flag: str, value: str,
                  flags: tuple[str, ...]) -> DataFrame:
    """Flagged array rows as one row per burst with a column per flag.

    The columns are named outright, so no first pass has to find the flags.
    """
    return df.groupBy(*key).agg(*[
        F.min_by(F.when(F.col(flag) == f, F.col(value)),
                 F.when(F.col(flag) == f, F.col("record_id"))).alias(f) for f in flags])


def _profile(sensors: DataFrame, cells: DataFrame, cell_columns: tuple[str, ...],
             all_columns: bool) -> DataFrame:
    key = burst_key(sensors, cells)
    if all_columns:
        left = sensors
    else:
        fmt = ["data_format"] if "data_format" in sensors.columns else []
        shown = [*BURST, *fmt]
        left = sensors.select(F.col("record_id").alias("sensor_id"), "received_at", *shown,
                              *[k for k in key if k not in shown],
                              *[c for c in SENSOR_COLUMNS if c in sensors.columns])
    out = left.join(_right(cells, key, {c: c for c in cell_columns}), key)
    return out if all_columns else out.drop(*[k for k in key if k == "measurement_id"])


def current_profile_df100(sensors: DataFrame, cells: DataFrame,
                          all_columns: bool = False) -> DataFrame:
    """Sensor row with every velocity cell of its burst."""
    return _profile(sensors, cells, ("cell_index", "vel1", "vel2", "vel3", "vel4", "speed",
                                     "direction"), all_columns)


def current_profile_12(sensors: DataFrame, cells: DataFrame, all_columns: bool = False) -> DataFrame:
    """As J2, with the data format in the key."""
    return _profile(sensors, cells, ("cell_index", "cell_distance", "vel1", "vel2", "vel3",
                                     "vel4"), all_columns)


def current_profile_34(headers: DataFrame, sensors: DataFrame, cells: DataFrame) -> DataFrame:
    """Header, sensor row and averaged cells of a burst."""
    key = burst_key(headers, sensors, cells)
    left = headers.select(F.col("record_id").alias("header_id"), "received_at", *BURST,
                          "data_format", *[k for k in key if k not in (*BURST, "data_format")],
                          "error_code", "status_code")
    out = left.join(_right(sensors, key, {c: c for c in SENSOR_COLUMNS}), key)
    out = out.join(_right(cells, key, {c: c for c in (
        "cell_index", "cell_distance", "speed", "direction")}), key)
    return out.drop("measurement_id")


def complete_bursts(energy: DataFrame, directions: DataFrame) -> DataFrame:
    """Energy rows whose burst has a mean direction and a spread, without duplicates."""
    key = burst_key(energy, directions)
    for kind in ("MD", "DS"):
        side = directions.where(F.col("direction_type") == kind).select(*key)
        energy = energy.join(side, key, "left_semi")
    stream = [c for c in key if c == "stream_id"]
    return energy.select(*stream, "measurement_date", "measurement_time", "received_at").distinct()


def completeness(parts: dict[str, DataFrame], key: list[str] | None = None) -> DataFrame:
    """Per burst, which components it has and how many it lacks.

    A union with one flag per component and a single aggregation: each task first reduces its
    own rows, so a burst with very many rows costs no more than any other.
    """
    key = key or burst_key(*parts.values())
    out = None
    for name, df in parts.items():
        marked = df.select(*key, *[F.lit(int(n == name)).alias(n) for n in parts])
        out = marked if out is None else out.unionByName(marked)
    seen = out.groupBy(*key).agg(*[F.max(n).alias(f"has_{n}") for n in parts])
    missing = sum((1 - F.col(f"has_{n}") for n in parts), F.lit(0))
    return seen.withColumn("missing_parts", missing)


def incomplete_bursts(parts: dict[str, DataFrame], key: list[str] | None = None) -> DataFrame:
    """The bursts that lack a component."""
    return completeness(parts, key).where("missing_parts > 0")
