"""M1-M9: tables of the old layout as frames of the consolidated one.

Jobs read old frames and return new ones; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.operators.aggregates import row_counts

# ------------------------------------------------------------------ fixed values: columns
_CONFIG = ("received_at original_sentence instrument_type_name instrument_type_code head_id "
           "beam_count cell_count blanking_distance cell_size coord_system_name "
           "coord_system_code checksum").split()
_SENSOR12 = ("received_at original_sentence measurement_date measurement_time error_code "
             "status_code battery sound_speed heading_std_dev heading pitch pitch_std_dev roll "
             "roll_std_dev pressure pressure_std_dev temperature checksum").split()
_SENSOR34 = ("received_at original_sentence measurement_date measurement_time battery "
             "sound_speed heading pitch roll pressure temperature checksum").split()
_CELL12 = ("received_at original_sentence measurement_date measurement_time cell_index "
           "cell_distance vel1 vel2 vel3 vel4 amp1 amp2 amp3 amp4 corr1 corr2 corr3 corr4 "
           "checksum").split()
_CELL34 = ("received_at original_sentence measurement_date measurement_time cell_index "
           "cell_distance speed direction checksum").split()
_HEADER = ("received_at original_sentence measurement_date measurement_time error_code "
           "status_code checksum").split()
_ENERGY = ("record_id received_at original_sentence measurement_date measurement_time "
           "spectrum_basis start_frequency step_frequency num_frequencies energy_densities "
           "checksum").split()

# Text cut to these lengths, missing numbers replaced by these values.
_CUT = {"measurement_date": 6, "measurement_time": 6, "checksum": 2}
_ZERO = {
    "pnors12": ("heading_std_dev", "pitch_std_dev", "roll_std_dev", "pressure_std_dev"),
    "pnorc12": ("cell_distance", "amp1", "amp2", "amp3", "amp4", "corr1", "corr2", "corr3", "corr4"),
    "pnorc34": ("cell_distance", "speed", "direction"),
    "pnorh": ("error_code",),
}

# Wave table: new column, type, old column (or none).
_WAVE = (
    ("spectrum_basis", None, "spectrum_basis"), ("processing_method", None, "processing_method"),
    ("hm0", "decimal(5,2)", "hm0"), ("h3", "decimal(5,2)", None), ("h10", "decimal(5,2)", None),
    ("hmax", "decimal(5,2)", "hmax"), ("tm02", "decimal(5,2)", "tm02"),
    ("tp", "decimal(5,2)", "tp"), ("tz", "decimal(5,2)", "mean_period"),
    ("dir_tp", "decimal(6,2)", "peak_dir"), ("spr_tp", "decimal(6,2)", "peak_directional_spread"),
    ("main_dir", "decimal(6,2)", "mean_dir"), ("uni_index", "decimal(5,2)", None),
    ("mean_pressure", "decimal(5,2)", None), ("num_no_detects", "int", None),
    ("num_bad_detects", "int", None), ("near_surface_speed", "decimal(5,2)", None),
    ("near_surface_dir", "decimal(6,2)", None), ("wave_error_code", None, "wave_error_code"),
)

# New table: (job id, old tables with their data format, columns, id column).
_UNIONS = {
    "pnori12": (("pnori1", 101), ("pnori2", 102)),
    "pnors12": (("pnors_df101", 101), ("pnors_df102", 102)),
    "pnors34": (("pnors_df103", 103), ("pnors_df104", 104)),
    "pnorc12": (("pnorc_df101", 101), ("pnorc_df102", 102)),
    "pnorc34": (("pnorc_df103", 103), ("pnorc_df104", 104)),
    "pnorh": (("pnorh_df103", 103), ("pnorh_df104", 104)),
}
_COLUMNS = {"pnori12": _CONFIG, "pnors12": _SENSOR12, "pnors34": _SENSOR34, "pnorc12": _CELL12,
            "pnorc34": _CELL34, "pnorh": _HEADER}

UNCHANGED = ("pnori", "pnors_df100", "pnorc_df100", "pnorb_data", "pnorf_data", "pnorwd_data",
             "pnora_data", "raw_lines", "parse_errors")
# ------------------------------------------------------------------- end of fixed values


def _moved(name: str, zero: tuple[str, ...]) -> Column:
    c = F.col(name)
    if name in _CUT:
        return F.substring(c, 1, _CUT[name]).alias(name)
    if name in zero:
        return F.coalesce(c, F.lit(0)).alias(name)
    return c


def energy(echo_data: DataFrame) -> DataFrame:
    """M1: echo_data to pnore_data."""
    return echo_data.select(F.lit("PNORE").alias("sentence_type"),
                            *[_moved(c, ()) for c in _ENERGY])


def consolidate(table: str, old: dict[str, DataFrame]) -> DataFrame | None:
    """M2-M7: the old tables of one new table, united under their data format.

    A new id is hashed from data format and old id, so that a repeated run gives the same ids;
    None where no old table is at hand.
    """
    out = None
    new_id = "config_id" if table == "pnori12" else "record_id"
    for name, data_format in _UNIONS[table]:
        if name not in old:
            continue
        df = old[name]
        old_id = new_id if new_id in df.columns else "record_id"
        columns = [F.xxhash64(F.lit(data_format), F.col(old_id)).alias(new_id),
                   F.lit(data_format).alias("data_format")]
        for c in _COLUMNS[table]:
            moved = _moved(c, _ZERO.get(table, ()))
            if table == "pnors12" and c == "error_code":
                moved = F.col(c).try_cast("int").alias(c)
            columns.append(moved)
        part = df.select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def waves(pnorw: DataFrame) -> DataFrame:
    """M8: renamed wave columns; a table without ``mean_dir`` is already new."""
    if "mean_dir" not in pnorw.columns:
        return pnorw
    columns = [F.col("record_id"), F.col("received_at"), F.col("sentence_type"),
               F.col("original_sentence"), _moved("measurement_date", ()),
               _moved("measurement_time", ())]
    for name, sql_type, source in _WAVE:
        c = F.lit(None) if source is None else F.col(source)
        columns.append((c.cast(sql_type) if sql_type else c).alias(name))
    return pnorw.select(*columns, _moved("checksum", ()))


def upgrade(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """M9: every job whose inputs are at hand, and the tables that stay as they are."""
    new: dict[str, DataFrame] = {n: old[n] for n in UNCHANGED if n in old}
    if "echo_data" in old:
        new["pnore_data"] = energy(old["echo_data"])
    for table in _UNIONS:
        df = consolidate(table, old)
        if df is not None:
            new[table] = df
    if "pnorw_data" in old:
        new["pnorw_data"] = waves(old["pnorw_data"])
    return new


def upgrade_counts(old: dict[str, DataFrame]) -> DataFrame:
    """M9: rows per job and per unchanged table, 0 where an input is missing."""
    spark = next(iter(old.values())).sparkSession
    empty = spark.range(0)
    none: Callable[[str], DataFrame] = lambda name: old.get(name, empty)
    jobs: dict[str, DataFrame] = {"echo_data->pnore_data": none("echo_data")}
    for table in _UNIONS:
        df = consolidate(table, old)
        jobs[f"old->{table}"] = df if df is not None else empty
    wave = none("pnorw_data")
    jobs["pnorw_data (renamed)"] = wave if "mean_dir" in wave.columns else empty
    for name in UNCHANGED:
        jobs[f"{name} (kept)"] = none(name)
    return row_counts(jobs)
