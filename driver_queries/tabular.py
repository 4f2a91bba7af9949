"""Filters, top-k, unions, joins, aggregations and windows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from brinelake.functions import arrays as A
from brinelake.operators import aggregates as G
from brinelake.operators import filters as K
from brinelake.operators import joins as J
from brinelake.operators import profiles, scans
from brinelake.operators import unions as U
from brinelake.session import fresh_folder
from driver_queries.registry import query, rounded

NOON = datetime(2024, 1, 15, 12)
AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"

# --------------------------------------------------------------------------- F: filters


@query("f01_project", "sensor", "SELECT heading, pitch FROM sensor")
def _(f):
    return K.project(f.sensor, ["heading", "no_such_column", "pitch"])


@query("f02_equality", "raw",
       "SELECT line_id, raw_sentence FROM raw WHERE record_type = 'PNORC' AND parse_status = 'OK'")
def _(f):
    return K.equals(f.raw, {"record_type": "PNORC", "parse_status": "OK"}).select(
        "line_id", "raw_sentence")


@query("f02_equality_none", "raw", "SELECT line_id FROM raw WHERE record_type = NULL")
def _(f):
    return K.equals(f.raw, {"record_type": None}).select("line_id")


@query("f03_time_window", "sensor",
       "SELECT record_id, heading FROM sensor WHERE received_at >= TIMESTAMP '2024-01-05 06:00:00'"
       f" AND received_at <= {AS_OF}")
def _(f):
    return K.time_window(f.sensor, datetime(2024, 1, 5, 6), NOON).select("record_id", "heading")


@query("f04_look_back", "sensor", " UNION ALL ".join(
    f"SELECT '{k}' AS span, COUNT(*) AS n FROM sensor WHERE received_at >= {AS_OF} - INTERVAL '{v}'"
    for k, v in (("1h", "1 hour"), ("6h", "6 hours"), ("24h", "24 hours"), ("7d", "7 days"),
                 ("30d", "30 days"))) + " UNION ALL SELECT 'all', COUNT(*) FROM sensor")
def _(f):
    out = None
    for span in (*K.LOOK_BACK, "all"):
        one = K.look_back(f.sensor, span, NOON).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(span).alias("span"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("f05_contains", "raw",
       "SELECT line_id FROM raw WHERE contains(lower(raw_sentence), 'pnorw') AND contains(lower(head_id), 'head1')")
def _(f):
    return K.contains_text(f.raw, {"raw_sentence": "PnorW", "head_id": "HEAD1"}).select("line_id")


@query("f06_raw_lines", "raw",
       f"SELECT * FROM raw WHERE record_type = 'PNORS' AND parse_status = 'OK' AND received_at <= {AS_OF}")
def _(f):
    return K.raw_line_query(f.raw, None, NOON, "PNORS", "OK")


@query("f07_errors", "errors",
       "SELECT * FROM errors WHERE error_type = 'PARSE_ERROR'")
def _(f):
    return K.error_query(f.errors, error_type="PARSE_ERROR")


_CONFIG_SQL = """(SELECT config_id, received_at,
 CASE data_format WHEN 100 THEN 'PNORI' WHEN 101 THEN 'PNORI1' ELSE 'PNORI2' END AS sentence_type,
 original_sentence, instrument_type_name, instrument_type_code, head_id, beam_count, cell_count,
 blanking_distance, cell_size, coord_system_name, coord_system_code, checksum FROM configs)"""


def _configs(f):
    return U.all_configurations(f.configs.where("data_format = 100"), f.configs.where("data_format > 100"))


@query("f08_configs", "configs", f"SELECT * FROM {_CONFIG_SQL} WHERE sentence_type = 'PNORI2'"
       " AND received_at >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY received_at DESC, config_id DESC LIMIT 20")
def _(f):
    return K.config_query(_configs(f), None, "PNORI2", datetime(2024, 1, 3), None, 20)


@query("f09_quality", "sensor", """SELECT record_id, CASE WHEN pitch > -9 THEN pitch END AS pitch,
 roll > -9 AS is_valid FROM sensor WHERE temperature IS NOT NULL""")
def _(f):
    rows = K.flag_invalid(K.null_invalid(K.present(f.sensor, "temperature"), "pitch"), "roll")
    return rows.select("record_id", "pitch", "is_valid")


@query("f10_day", "sensor", "SELECT record_id FROM sensor WHERE CAST(received_at AS DATE) = DATE '2024-01-09'")
def _(f):
    return K.on_day(f.sensor, date(2024, 1, 9)).select("record_id")


@query("f11_recent", "raw", f"SELECT COUNT(*) AS recent FROM raw WHERE received_at > {AS_OF} - INTERVAL '90 minutes'")
def _(f):
    return K.recent_count(f.raw, 90, NOON)


@query("f12_validity", "sensor", """SELECT record_id,
 array_to_string(list_filter([CASE WHEN temperature IS NULL THEN 'missing temperature' END,
  CASE WHEN temperature < -5 OR temperature > 50 THEN 'temperature out of range' END,
  CASE WHEN pressure < 0 OR pressure > 20000 THEN 'pressure out of range' END,
  CASE WHEN heading < 0 OR heading >= 360 THEN 'heading out of range' END,
  CASE WHEN pitch < -90 OR pitch > 90 THEN 'pitch out of range' END,
  CASE WHEN roll < -180 OR roll > 180 THEN 'roll out of range' END,
  CASE WHEN battery < 0 OR battery > 30 THEN 'battery out of range' END,
  CASE WHEN sound_speed < 1400 OR sound_speed > 2000 THEN 'sound_speed out of range' END],
  lambda x: x IS NOT NULL), '; ') AS problems,
 temperature IS NOT NULL AND battery <= 30 AND sound_speed BETWEEN 1400 AND 2000 AS is_fully_valid
 FROM sensor""")
def _(f):
    rows = K.validity_report(f.sensor, ("temperature",))
    return rows.select("record_id", F.array_join("validation_errors", "; ").alias("problems"),
                       "is_fully_valid")


@query("f12_config_validity", "configs", """SELECT config_id,
 (instrument_type_code = 4 AND beam_count <> 4) OR (instrument_type_code IN (0, 2) AND beam_count NOT IN (1, 2, 3)) AS beam_problem,
 blanking_distance >= cell_size * cell_count AS range_problem FROM configs""")
def _(f):
    rows = K.validity_report(f.configs)
    has = lambda text: F.exists("validation_errors", lambda e: e.startswith(text))
    return rows.select("config_id", has("beam_count").alias("beam_problem"),
                       has("blanking").alias("range_problem"))


@query("f13_code_labels", "configs", """SELECT config_id,
 CASE instrument_type_code WHEN 0 THEN 'AQUADOPP' WHEN 2 THEN 'AQUADOPP_PROFILER' WHEN 4 THEN 'SIGNATURE' END AS instrument_type,
 CASE coord_system_code WHEN 0 THEN 'ENU' WHEN 1 THEN 'XYZ' WHEN 2 THEN 'BEAM' END AS coord_system FROM configs""")
def _(f):
    from brinelake import layouts as L
    from brinelake.plans.parse import code_name

    back = {v: k for k, v in L.COORDINATE_CODES.items()}
    return f.configs.select(
        "config_id", code_name(F.col("instrument_type_code"), L.INSTRUMENT_NAMES).alias("instrument_type"),
        code_name(F.col("coord_system_code"), back).alias("coord_system"))


@query("f14_format_labels", "sensor",
       "SELECT record_id, 'DF' || CAST(data_format AS VARCHAR) AS format, CASE data_format WHEN 100 THEN 'PNORI'"
       " WHEN 101 THEN 'PNORI1' ELSE 'PNORI2' END AS config_type FROM sensor")
def _(f):
    return f.sensor.select("record_id", K.format_label().alias("format"), K.config_label().alias("config_type"))


# ---------------------------------------------------------------------- K: order and limits
@query("k01_newest", "sensor",
       "SELECT record_id, received_at, temperature FROM sensor ORDER BY received_at DESC, record_id DESC LIMIT 100")
def _(f):
    return K.first_rows(f.sensor, "received_at", "record_id", 100).select(
        "record_id", "received_at", "temperature")


@query("k02_query", "sensor",
       "SELECT record_id, heading FROM sensor ORDER BY heading ASC NULLS LAST, record_id ASC LIMIT 250")
def _(f):
    return K.query(f.sensor, ["record_id", "heading"], 250, "heading", descending=False)


@query("k03_time_series", "sensor", f"""SELECT received_at, heading, temperature FROM sensor
 WHERE received_at >= {AS_OF} - INTERVAL '7 days'""")
def _(f):
    return K.time_series(f.sensor, ["heading", "temperature"], "7d", NOON)


@query("k03_multi_series", "sensor cells", """SELECT * FROM (
 SELECT 'pressure' AS label, received_at AS x, pressure AS y FROM sensor
 UNION ALL SELECT 'heading', received_at, heading FROM sensor
 UNION ALL SELECT 'vel1', received_at, vel1 FROM cells)""")
def _(f):
    return K.multi_series([("pressure", f.sensor, "pressure"), ("heading", f.sensor, "heading"),
                           ("vel1", f.cells, "vel1")])


@query("k04_time_then_cell", "cells",
       "SELECT received_at, cell_index, vel1, vel2 FROM cells ORDER BY received_at DESC, cell_index, record_id LIMIT 50")
def _(f):
    return K.time_then_cell(f.cells, 50).select("received_at", "cell_index", "vel1", "vel2")


@query("k05_some_rows", "waves", "SELECT * FROM waves ORDER BY record_id LIMIT 20")
def _(f):
    return K.some_rows(f.waves, 20)


# ------------------------------------------------------------------------------ U: unions
@query("u01_configurations", "configs", f"SELECT * FROM {_CONFIG_SQL}")
def _(f):
    return _configs(f)


@query("u02_all_sensors", "sensor", """SELECT record_id, received_at, 'DF' || CAST(data_format AS VARCHAR) AS format,
 heading, pitch, roll, pressure, temperature FROM sensor""")
def _(f):
    s = f.sensor
    return U.all_sensors(s.where("data_format = 100"), s.where("data_format IN (101, 102)"),
                         s.where("data_format IN (103, 104)"))


@query("u03_all_velocities", "cells", """SELECT record_id, received_at, 'DF' || CAST(data_format AS VARCHAR) AS format,
 cell_index, vel1, vel2, vel3, vel4 FROM cells WHERE data_format <= 102""")
def _(f):
    c = f.cells
    return U.all_velocities(c.where("data_format = 100"), c.where("data_format IN (101, 102)"))


@query("u04_headers", "sensor", """SELECT record_id, received_at, 'DF' || CAST(data_format AS VARCHAR) AS format,
 error_code, status_code FROM sensor WHERE data_format >= 103""")
def _(f):
    return U.headers(f.sensor.where("data_format >= 103"))


@query("u05_bursts", "cells", f"""SELECT DISTINCT stream_id, measurement_date, measurement_time, received_at,
 measurement_date || ' ' || measurement_time AS label FROM cells WHERE received_at <= {AS_OF}""")
def _(f):
    return U.bursts(f.cells, None, NOON)


@query("u06_union_by_name", "sensor waves", """SELECT record_id, received_at, heading, NULL::DOUBLE AS hm0 FROM sensor
 UNION ALL SELECT record_id, received_at, NULL, hm0 FROM waves""")
def _(f):
    return U.union_widening([f.sensor.select("record_id", "received_at", "heading"),
                             f.waves.select("record_id", "received_at", "hm0")])


# ------------------------------------------------------------------------------- J: joins
_ON = "ON {a}.measurement_date = {b}.measurement_date AND {a}.measurement_time = {b}.measurement_time"


def _on(a: str, b: str) -> str:
    return _ON.replace("{a}", a).replace("{b}", b)


@query("j01_wave_measurement", "waves energy", f"""SELECT w.record_id, w.hm0, w.tp, w.main_dir,
 e.start_frequency AS energy_start_freq, e.num_frequencies AS energy_num_freq,
 round(list_sum(e.energy_densities), 6) AS energy_sum FROM waves w LEFT JOIN energy e {_on('w', 'e')}""")
def _(f):
    return rounded(J.wave_measurement(f.waves, f.energy).select(
        "record_id", "hm0", "tp", "main_dir", "energy_start_freq", "energy_num_freq",
        F.aggregate("energy_densities", F.lit(0.0), lambda a, x: a + x).alias("energy_sum")))


_PROFILE = "s.stream_id, s.heading, s.pitch, s.roll, s.pressure, s.temperature, c.cell_index"


@query("j02_profile_df100", "sensor cells", f"""SELECT s.record_id AS sensor_id, s.received_at, s.measurement_date,
 s.measurement_time, {_PROFILE}, c.vel1, c.vel2, c.vel3, c.vel4, c.speed, c.direction
 FROM sensor s JOIN cells c {_on('s', 'c')} AND s.stream_id = c.stream_id WHERE s.data_format = 100 AND c.data_format = 100""")
def _(f):
    return J.current_profile_df100(f.sensor.where("data_format = 100").drop("data_format"),
                                   f.cells.where("data_format = 100").drop("data_format"))


@query("j03_wave_full", "waves energy bands coefs dirs", f"""SELECT w.record_id, b.hmo AS band_hm0, f.coefficient_flag,
 wd.direction_type, round(f.coefficients[1], 6) AS first_coefficient, round(wd.values[1], 6) AS first_direction,
 round(e.energy_densities[1], 6) AS first_energy
 FROM waves w LEFT JOIN energy e {_on('w', 'e')} LEFT JOIN bands b {_on('w', 'b')}
 LEFT JOIN coefs f {_on('w', 'f')} LEFT JOIN dirs wd {_on('w', 'wd')}""")
def _(f):
    out = J.wave_measurement_full(f.waves, f.energy, f.bands, f.coefs, f.dirs)
    return rounded(out.select(
        "record_id", "band_hm0", "coefficient_flag", "direction_type",
        F.get("coefficients", F.lit(0)).alias("first_coefficient"),
        F.get("directional_values", F.lit(0)).alias("first_direction"),
        F.get("energy_densities", F.lit(0)).alias("first_energy")))


@query("j03b_wave_bursts", "waves energy spectra", """SELECT w.record_id, w.hm0,
 round(list_sum(max(CASE WHEN s.kind = 'E' THEN s.vals END)), 6) AS e_sum,
 round(list_sum(max(CASE WHEN s.kind = 'A1' THEN s.vals END)), 6) AS a1_sum,
 round(list_sum(max(CASE WHEN s.kind = 'B1' THEN s.vals END)), 6) AS b1_sum,
 round(list_sum(max(CASE WHEN s.kind = 'A2' THEN s.vals END)), 6) AS a2_sum,
 round(list_sum(max(CASE WHEN s.kind = 'B2' THEN s.vals END)), 6) AS b2_sum,
 round(list_sum(max(CASE WHEN s.kind = 'MD' THEN s.vals END)), 6) AS md_sum,
 round(list_sum(max(CASE WHEN s.kind = 'DS' THEN s.vals END)), 6) AS ds_sum
 FROM waves w LEFT JOIN spectra s ON s.burst_no = w.record_id GROUP BY w.record_id, w.hm0""")
def _(f):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = J.wave_bursts(f.waves, f.energy, f.coefs, f.dirs)
    return rounded(out.select("record_id", "hm0", total("energy_densities").alias("e_sum"), *[
        total(c).alias(f"{c.lower()}_sum") for c in ("A1", "B1", "A2", "B2", "MD", "DS")]))


@query("j04_profile_12", "sensor cells", f"""SELECT s.record_id AS sensor_id, s.data_format, s.received_at,
 s.measurement_date, s.measurement_time, {_PROFILE}, c.cell_distance, c.vel1, c.vel2, c.vel3, c.vel4
 FROM sensor s JOIN cells c {_on('s', 'c')} AND s.data_format = c.data_format AND s.stream_id = c.stream_id WHERE s.data_format IN (101, 102)""")
def _(f):
    return J.current_profile_12(f.sensor.where("data_format IN (101, 102)"), f.cells)


@query("j05_profile_34", "sensor cells", f"""SELECT h.record_id AS header_id, h.data_format, h.received_at,
 h.measurement_date, h.measurement_time, h.error_code, h.status_code, {_PROFILE}, c.cell_distance, c.speed, c.direction
 FROM sensor h JOIN sensor s {_on('h', 's')} AND h.data_format = s.data_format AND h.stream_id = s.stream_id
 JOIN cells c {_on('h', 'c')} AND h.data_format = c.data_format AND h.stream_id = c.stream_id WHERE h.data_format IN (103, 104)""")
def _(f):
    s = f.sensor.where("data_format IN (103, 104)")
    return J.current_profile_34(s, s, f.cells)


@query("j06_integer_key", "sensor cells", f"""SELECT s.record_id, c.record_id AS cell_id FROM sensor s
 JOIN cells c {_on('s', 'c')}""")
def _(f):
    from brinelake.functions.sentences import measurement_id

    mid = measurement_id("measurement_date", "measurement_time")
    s = f.sensor.select("record_id", mid.alias("measurement_id"))
    c = f.cells.select(F.col("record_id").alias("cell_id"), mid.alias("measurement_id"))
    return s.join(c, J.burst_key(s, c)).select("record_id", "cell_id")


@query("j08_complete_bursts", "energy dirs", f"""SELECT DISTINCT e.measurement_date, e.measurement_time, e.received_at
 FROM energy e JOIN dirs md {_on('e', 'md')} AND md.direction_type = 'MD'
 JOIN dirs ds {_on('e', 'ds')} AND ds.direction_type = 'DS'""")
def _(f):
    return J.complete_bursts(f.energy, f.dirs)


@query("j09_incomplete_bursts", "spectra", """SELECT measurement_date, measurement_time,
 CAST(max(CAST(kind = 'E' AS INT)) AS INT) AS has_energy, CAST(max(CAST(kind IN ('A1','B1','A2','B2') AS INT)) AS INT) AS has_coefs,
 CAST(max(CAST(kind IN ('MD','DS') AS INT)) AS INT) AS has_dirs,
 CAST(3 - has_energy - has_coefs - has_dirs AS INT) AS missing_parts
 FROM spectra GROUP BY ALL HAVING missing_parts > 0""")
def _(f):
    return J.incomplete_bursts({"energy": f.energy, "coefs": f.coefs, "dirs": f.dirs}, J.BURST)


# ------------------------------------------------------------------------ G: aggregations
for _minutes, _fn in ((5, "avg"), (7, "sum"), (11, "max"), (60, "count"), (60, "median")):
    _duck = "avg" if _fn == "median" else _fn
    _value = f"round({_duck}(pressure), 6)" if _duck in ("avg", "sum") else f"{_duck}(pressure)"

    @query(f"g01_bucket_{_minutes}m_{_fn}", "sensor", f"""SELECT time_bucket(INTERVAL '{_minutes} minutes', received_at)
     AS bucket, {_value} AS value FROM sensor GROUP BY 1 ORDER BY 1""")
    def _(f, minutes=_minutes, fn=_fn):
        return rounded(G.time_buckets(f.sensor, "pressure", minutes, fn))


@query("g02_column_stats", "sensor", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS min_val, max({c}) AS max_val, round(avg({c}), 6) AS avg_val,"
    f" count({c}) AS count FROM sensor" for c in ("heading", "pitch", "pressure", "temperature")))
def _(f):
    return rounded(G.column_stats(f.sensor, ["heading", "pitch", "pressure", "temperature"]))


@query("g03_deviation", "sensor", "SELECT 'temperature' AS column_name, min(temperature) AS min_val, max(temperature)"
       " AS max_val, round(avg(temperature), 6) AS avg_val, count(temperature) AS count,"
       " round(stddev_samp(temperature), 6) AS stddev_val FROM sensor")
def _(f):
    return rounded(G.column_stats(f.sensor, ["temperature"], deviation=True))


@query("g04_histogram", "sensor",
       "SELECT floor(heading / 10) * 10 AS bin, count(*) AS count FROM sensor WHERE heading IS NOT NULL GROUP BY 1")
def _(f):
    return G.histogram(f.sensor, "heading")


@query("g05_hourly", "sensor", """SELECT date_trunc('hour', received_at) AS hour, round(avg(heading), 6) AS avg_heading,
 round(avg(temperature), 6) AS avg_temperature, round(avg(pressure), 6) AS avg_pressure FROM sensor GROUP BY 1""")
def _(f):
    return rounded(G.per_period(f.sensor, ["heading", "temperature", "pressure"]))


@query("g06_daily", "sensor", """SELECT CAST(received_at AS DATE) AS day, count(*) AS records,
 round(avg(heading), 6) AS avg_heading, round(avg(temperature), 6) AS avg_temperature FROM sensor GROUP BY 1""")
def _(f):
    return rounded(G.per_period(f.sensor, ["heading", "temperature"], "day", with_count=True))


@query("g07_per_cell", "cells", """SELECT cell_index, count(*) AS measurements, round(avg(vel1), 6) AS avg_vel1,
 round(avg(vel2), 6) AS avg_vel2, round(avg(vel4), 6) AS avg_vel4 FROM cells GROUP BY 1""")
def _(f):
    return rounded(G.per_cell(f.cells, ["vel1", "vel2", "vel4"]))


@query("g08_type_counts", "raw", "SELECT record_type, checksum_valid, count(*) AS count FROM raw GROUP BY 1, 2")
def _(f):
    return G.counts(f.raw, "record_type", "checksum_valid")


@query("g09_error_frequency", "errors", """SELECT error_type, count(*) AS count, min(received_at) AS first_occurrence,
 max(received_at) AS last_occurrence FROM errors GROUP BY 1""")
def _(f):
    return G.error_frequency(f.errors)


@query("g10_errors_per_hour", "errors",
       "SELECT date_trunc('hour', received_at) AS hour, count(*) AS error_count FROM errors GROUP BY 1")
def _(f):
    return G.errors_per_hour(f.errors)


@query("g11_daily_log", "raw", """SELECT CAST(date_trunc('day', received_at) AS TIMESTAMP) AS day, record_type, count(*) AS record_count,
 count(DISTINCT head_id) AS instrument_count, count(*) FILTER (WHERE checksum_valid) AS valid_count,
 count(*) FILTER (WHERE NOT checksum_valid) AS invalid_count FROM raw GROUP BY 1, 2""")
def _(f):
    return G.daily_log_stats(f.raw)


@query("g11_distinct_sketches", "raw", """SELECT record_type, count(*) AS record_count, count(DISTINCT head_id) AS heads, true AS near
 FROM raw WHERE CAST(received_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""")
def _(f):
    """A period's counts from stored daily sketches; near: ids, of which there are many, within 5 % of the exact count."""
    path = fresh_folder(f.spark, "sketches")
    G.distinct_sketches(f.raw, ["record_type"], ["head_id", "line_id"]).write.parquet(path)
    start, end = datetime(2024, 1, 5), datetime(2024, 1, 20)
    told = G.distinct_counts(f.spark.read.parquet(path), ["record_type"], ["head_id", "line_id"], start, end)
    exact = K.time_window(f.raw, start, datetime(2024, 1, 20, 23, 59, 59, 999999)).groupBy("record_type").agg(
        F.count_distinct("line_id").alias("ids"))
    return told.join(exact, "record_type").select(
        "record_type", "record_count", F.col("distinct_head_id").alias("heads"),
        (F.abs(F.col("distinct_line_id") - F.col("ids")) <= 0.05 * F.col("ids")).alias("near"))


@query("g12_instruments", "sensor", """SELECT instrument_type_name, head_id, count(*) AS total_records,
 min(received_at) AS first_seen, max(received_at) AS last_seen, round(avg(temperature), 6) AS avg_temperature,
 min(pressure) AS min_pressure, max(pressure) AS max_pressure FROM sensor GROUP BY 1, 2""")
def _(f):
    return rounded(G.instrument_stats(f.sensor))


@query("g13_row_counts", "sensor cells raw", """SELECT 'sensor' AS table_name, count(*) AS row_count FROM sensor
 UNION ALL SELECT 'cells', count(*) FROM cells UNION ALL SELECT 'raw', count(*) FROM raw
 UNION ALL SELECT 'none', 0""")
def _(f):
    return G.row_counts({"sensor": f.sensor, "cells": f.cells, "raw": f.raw,
                         "none": f.raw.where("line_id IS NULL")})


_AMP = "(coalesce(amp1, 0) + coalesce(amp2, 0) + coalesce(amp3, 0) + coalesce(amp4, 0)) / 4.0"


_AMPS = f"SELECT stream_id, received_at, cell_index, record_id, {_AMP} AS avg_amp FROM"
_MAPS = "SELECT stream_id, received_at, array_to_string(list(round(avg_amp, 2) ORDER BY cell_index, record_id), ' ') AS amplitudes"


@query("g14_amp_cells", "cells", f"SELECT stream_id, received_at, cell_index, {_AMP} AS avg_amp FROM cells")
def _(f):
    return G.amplitude_cells(f.cells)


@query("g14_amp_heatmap", "cells", f"{_MAPS} FROM ({_AMPS} cells) GROUP BY 1, 2")
def _(f):
    return _amplitudes(f.cells, None)


@query("g14_two_streams", "twin_cells", f"{_MAPS} FROM ({_AMPS} twin_cells) GROUP BY 1, 2")
def _(f):
    """Two instruments at every time, none mixed into the other."""
    return _amplitudes(f.twin_cells, None)


@query("g14_amp_newest", "twin_cells", f"""{_MAPS} FROM ({_AMPS} twin_cells) WHERE (stream_id, received_at) IN
 (SELECT (stream_id, received_at) FROM (SELECT DISTINCT stream_id, received_at FROM twin_cells)
  QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY received_at DESC) <= 40) GROUP BY 1, 2""")
def _(f):
    return _amplitudes(f.twin_cells, 40)


def _amplitudes(cells, times):
    rows = G.amplitude_heatmap(cells, times)
    return rows.select("stream_id", "received_at", F.array_join(F.transform(
        "amplitudes", lambda a: F.round(a, 2).cast("string")), " ").alias("amplitudes"))


@query("g15_profile_means", "cells", """SELECT round(avg(vel1), 6) AS mean_vel1, round(avg(vel3), 6) AS mean_vel3,
 round(avg(vel4), 6) AS mean_vel4 FROM cells""")
def _(f):
    return rounded(G.profile_means(f.cells, ["vel1", "vel3", "vel4"]))


@query("g16_latest_times", "sensor cells errors", """SELECT 'sensor' AS table_name, max(received_at) AS latest FROM sensor
 UNION ALL SELECT 'cells', max(received_at) FROM cells UNION ALL SELECT 'errors', max(received_at) FROM errors""")
def _(f):
    return G.latest_times({"sensor": f.sensor, "cells": f.cells, "errors": f.errors})


@query("g16_latest_row", "sensor", "SELECT heading, temperature, pressure FROM sensor ORDER BY received_at DESC, record_id DESC LIMIT 1")
def _(f):
    return G.latest_row(f.sensor, ["heading", "temperature", "pressure"])


# ----------------------------------------------------------------------------- W: windows
CARRIED_SQL = """SELECT line_no, stream_id, record_type, carried_date, carried_time, carried_status,
 CASE WHEN record_type = 'PNORC3' THEN CAST(count(*) FILTER (WHERE record_type = 'PNORC3')
  OVER (PARTITION BY stream_id, g ORDER BY line_no) AS INT) END AS cell_index
 FROM (SELECT *, last_value(CASE WHEN h THEN d END IGNORE NULLS) OVER w AS carried_date,
  last_value(CASE WHEN h THEN t END IGNORE NULLS) OVER w AS carried_time,
  last_value(CASE WHEN h THEN s END IGNORE NULLS) OVER w AS carried_status, count(*) FILTER (WHERE h) OVER w AS g
  FROM (SELECT *, record_type IN ('PNORH3', 'PNORH4') AS h FROM bursts34)
  WINDOW w AS (PARTITION BY stream_id ORDER BY line_no))"""


@query("w01_header_carry", "bursts34", f"SELECT * EXCLUDE (stream_id) FROM ({CARRIED_SQL})")
def _(f):
    rows = f.bursts34.withColumn("chunk", scans.line_chunk("line_no", 512))
    out = scans.attach_headers(
        rows, ["stream_id"], ["chunk"], ["line_no"], ok=F.lit(True), date=F.col("d"),
        time=F.col("t"), status=F.col("s"))
    return out.select("line_no", "record_type", "carried_date", "carried_time", "carried_status",
                      "cell_index")


_RUNS = """(SELECT *, count(*) FILTER (WHERE NOT is_bin) OVER (PARTITION BY stream_id ORDER BY line_no) AS run_no FROM blob_lines)"""


@query("w02_blob_index", "blob_lines", f"""SELECT stream_id, run_no, count(*) AS line_count,
 CAST(sum(strlen(raw_sentence)) AS BIGINT) AS byte_count, min(received_at) AS started_at
 FROM {_RUNS} WHERE is_bin GROUP BY 1, 2""")
def _(f):
    rows = f.blob_lines.withColumn("chunk", scans.line_chunk("line_no", 512))
    return scans.blob_index(rows, "raw_sentence", F.col("is_bin"), ["stream_id"], ["chunk"],
                            ["line_no"]).drop("first_position")


@query("w02_blob_parts", "blob_lines", f"""SELECT stream_id, run_no, line_no // 512 AS chunk,
 string_agg(raw_sentence, '' ORDER BY line_no) AS payload, count(*) AS line_count
 FROM {_RUNS} WHERE is_bin GROUP BY 1, 2, 3""")
def _(f):
    rows = f.blob_lines.withColumn("chunk", scans.line_chunk("line_no", 512))
    out = scans.blob_parts(rows, "raw_sentence", F.col("is_bin"), ["stream_id"], ["chunk"], ["line_no"])
    return out.select("stream_id", "run_no", "chunk", F.col("payload").cast("string").alias("payload"),
                      "line_count")


@query("w03_latest_burst", "cells",
       "SELECT record_id, cell_index, vel1 FROM cells WHERE measured_at = (SELECT max(measured_at) FROM cells)")
def _(f):
    return scans.latest_burst(f.cells).select("record_id", "cell_index", "vel1")


@query("w04_layered", "coefs", """SELECT record_id, coefficient_flag, received_at FROM coefs
 QUALIFY row_number() OVER (PARTITION BY coefficient_flag ORDER BY received_at DESC, record_id DESC) <= 5""")
def _(f):
    from brinelake.operators.spectra import layered

    return layered(f.coefs).select("record_id", "coefficient_flag", "received_at")


# ---------------------------------------------------------------------------- D4-D6, D13
_DEPTH = "coalesce(cell_distance, 0.5 + cell_index * 2.0)"


@query("d04_latest_profile", "twin_cells", f"""SELECT stream_id, measured_at, cell_index, {_DEPTH} AS depth, vel1, vel2, vel3, vel4
 FROM twin_cells JOIN (SELECT stream_id, max(measured_at) AS measured_at FROM twin_cells GROUP BY 1) USING (stream_id, measured_at)""")
def _(f):
    return profiles.velocity_profiles(f.twin_cells, cell_size=2.0)


@query("d05_profiles", "twin_cells", f"""SELECT stream_id, measured_at, cell_index, {_DEPTH} AS depth, vel1, vel2 FROM twin_cells
 WHERE measured_at IN (TIMESTAMP '2024-01-01 00:06:29', TIMESTAMP '2024-01-01 00:08:25', TIMESTAMP '2024-01-01 00:08:26')""")
def _(f):
    times = [datetime(2024, 1, 1, 0, 6, 29), datetime(2024, 1, 1, 0, 8, 25), datetime(2024, 1, 1, 0, 8, 26)]
    return profiles.velocity_profiles(f.twin_cells, ["vel1", "vel2"], 2.0, timestamps=times)


@query("d06_configured_depth", "cells config_log", """SELECT c.record_id, c.cell_index,
 round(coalesce(c.cell_distance, g.blanking_distance + c.cell_index * g.cell_size), 6) AS depth
 FROM cells c ASOF LEFT JOIN (SELECT stream_id, received_at, unnest(max(struct_pack(blanking_distance, cell_size)))
  FROM config_log GROUP BY 1, 2) g ON c.stream_id = g.stream_id AND c.received_at >= g.received_at""")
def _(f):
    out = profiles.configured_profiles(f.cells, f.config_log, ["stream_id"])
    return rounded(out.select("record_id", "cell_index", "depth"))


@query("d06_one_stream", "cells config_log", """SELECT c.record_id, c.cell_index,
 round(coalesce(c.cell_distance, g.blanking_distance + c.cell_index * g.cell_size), 6) AS depth, true AS spread
 FROM (SELECT * REPLACE (1 AS stream_id, TIMESTAMP '2024-01-15' + INTERVAL '1 second' * (record_id % 86000) AS received_at) FROM cells) c
 ASOF LEFT JOIN (SELECT TIMESTAMP '2024-01-15' + INTERVAL '1 second' * ((epoch_us(received_at) // 1000003) % 86000) AS received_at,
  unnest(max(struct_pack(blanking_distance, cell_size))) FROM config_log GROUP BY 1) g ON c.received_at >= g.received_at""")
def _(f):
    """One stream that holds everything, all of it on one day; spread: its rows lie in many ranges."""
    day = "TIMESTAMP_NTZ'2024-01-15' + make_dt_interval(0, 0, 0, {})"
    cells = f.cells.withColumns({"stream_id": F.lit(1), "received_at": F.expr(day.format("record_id % 86000"))})
    log = f.config_log.withColumns({"stream_id": F.lit(1), "received_at": F.expr(day.format(
        "(unix_micros(CAST(received_at AS TIMESTAMP)) div 1000003) % 86000"))})
    bursts = cells.select("stream_id", "received_at").distinct()
    ranges = scans.dealt_ranges(bursts, log, ["stream_id"], "received_at", "received_at", ["blanking_distance", "cell_size"], parts=16)
    spread = ranges.groupBy("_chunk").count().agg((F.count(F.lit(1)) >= 12).alias("spread"))
    out = profiles.configured_profiles(cells, log, ["stream_id"])
    return rounded(out.select("record_id", "cell_index", "depth")).crossJoin(spread)


@query("d13_amplitude_grid", "twin_cells", f"""SELECT stream_id, cell_index,
 max({_AMP}) FILTER (WHERE measured_at = TIMESTAMP '2024-01-01 00:06:29') AS t0,
 max({_AMP}) FILTER (WHERE measured_at = TIMESTAMP '2024-01-01 00:08:25') AS t1 FROM twin_cells GROUP BY 1, 2""")
def _(f):
    rows = G.amplitude_cells(f.twin_cells, ts="measured_at")
    return profiles.amplitude_grid(
        rows, [datetime(2024, 1, 1, 0, 6, 29), datetime(2024, 1, 1, 0, 8, 25)], "measured_at")


# ------------------------------------------------------------------------ X: functions
@query("x07_speed_direction", "cells", """SELECT record_id, round(sqrt(vel1 * vel1 + vel2 * vel2), 6) AS speed,
 round(degrees(atan2(vel1, vel2)), 6) AS direction,
 round(CASE WHEN degrees(atan2(vel1, vel2)) < 0 THEN degrees(atan2(vel1, vel2)) + 360 ELSE degrees(atan2(vel1, vel2)) END, 6) AS compass
 FROM cells WHERE vel1 IS NOT NULL AND vel2 IS NOT NULL""")
def _(f):
    return rounded(K.present(f.cells, "vel1", "vel2").select(
        "record_id", A.speed("vel1", "vel2").alias("speed"), A.direction("vel1", "vel2").alias("direction"),
        A.direction("vel1", "vel2", compass=True).alias("compass")))


@query("x08_json_arrays", "spectra", """SELECT record_id, len(vals) AS n, round(list_sum(vals), 6) AS total,
 round(vals[64], 6) AS last_value FROM spectra""")
def _(f):
    rows = f.spectra.select("record_id", A.decode_array(A.encode_array("vals")).alias("v"))
    return rounded(rows.select(
        "record_id", F.size("v").cast("bigint").alias("n"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.get("v", F.lit(63)).alias("last_value")))


@query("x11_frequency_axis", "energy", """SELECT record_id, unnest(list_transform(range(num_frequencies),
 lambda i: round(start_frequency + i * step_frequency, 4))) AS frequency FROM energy""")
def _(f):
    return f.energy.select("record_id", F.explode(A.frequency_axis(
        "start_frequency", "step_frequency", "num_frequencies")).alias("frequency"))


@query("x_scalars", "sensor", """SELECT record_id, coalesce(temperature, -1.0) AS temp, substring(status_code, 6, 3) AS tail,
 position('0' IN head_id) AS zero_at, length(head_id) AS head_len, upper(instrument_type_name) AS upper_name,
 regexp_matches(head_id, '1.$') AS ends_in_teens, CAST(heading AS INTEGER) AS whole_heading,
 round(exp(pitch / 10), 6) AS e, round(pitch - floor(pitch / 7) * 7, 6) AS pmod7, measurement_date || '-' || measurement_time AS stamp,
 CASE WHEN roll < 0 THEN 'port' WHEN roll = 0 THEN 'even' ELSE 'starboard' END AS side FROM sensor""")
def _(f):
    return rounded(f.sensor.select(
        "record_id", F.coalesce("temperature", F.lit(-1.0)).alias("temp"),
        F.substring("status_code", 6, 3).alias("tail"),
        F.instr("head_id", "0").cast("bigint").alias("zero_at"),
        F.length("head_id").cast("bigint").alias("head_len"),
        F.upper("instrument_type_name").alias("upper_name"),
        F.col("head_id").rlike("1.$").alias("ends_in_teens"),
        F.bround("heading").cast("int").alias("whole_heading"), F.exp(F.col("pitch") / 10).alias("e"),
        F.pmod(F.col("pitch"), F.lit(7.0)).alias("pmod7"),
        F.concat_ws("-", "measurement_date", "measurement_time").alias("stamp"),
        F.when(F.col("roll") < 0, "port").when(F.col("roll") == 0, "even").otherwise("starboard").alias("side")))
