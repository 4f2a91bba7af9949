"""Telemetry-shaped frames over the given tables, written once for both engines.

The given tables hold no telemetry.  Each frame here reads them whole and gives their rows the
column names the operators work on.  A frame is one SQL text with placeholders for the few
spellings in which the engines differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_SPARK = {
    "MDY": "date_format({0},'MMddyy')", "YMD": "date_format({0},'yyMMdd')",
    "HMS": "date_format({0},'HHmmss')", "IDIV": "DIV", "STR": "STRING", "N": "_NTZ",
    "XOR": "lpad(hex(aggregate(split({0},''),0,(a,c)->a^ascii(c))),2,'0')",
    "AT20": "TIMESTAMP_NTZ'2026-01-16 00:00:00' + make_dt_interval(0,0,CAST(({0}) AS INT)*20)",
    "PMOD": "pmod({0},360e0)", "L": "{0} ->", "EACH": "transform",
    "SERIES": "array_join(transform(sequence(0,{0}-1), i -> {1}),',')",
    "JSON": "to_json({0})", "NLIST": "CAST({0} AS ARRAY<DOUBLE>)", "DAYS": "make_dt_interval({0})",
    "TWO": "explode(array(0, 1))", "SPREAD": "",
}
_DUCK = {
    "MDY": "strftime({0},'%m%d%y')", "YMD": "strftime({0},'%y%m%d')",
    "HMS": "strftime({0},'%H%M%S')", "IDIV": "//", "STR": "VARCHAR", "N": "",
    "XOR": "printf('%02X', list_reduce(list_transform(string_split({0},''), "
           "lambda c: ord(c)), lambda a,c: xor(a,c)))",
    "AT20": "TIMESTAMP '2026-01-16 00:00:00' + to_minutes(({0})*20)",
    "PMOD": "((({0}) % 360) + 360) % 360", "L": "lambda {0}:", "EACH": "list_transform",
    "SERIES": "array_to_string(list_transform(range({0}), lambda i: {1}),',')",
    "JSON": "CAST(to_json({0}) AS VARCHAR)", "NLIST": "CAST({0} AS DOUBLE[])",
    "DAYS": "to_days({0})", "TWO": "unnest([0, 1])", "SPREAD": "", "DEAL": "{0}", "STRIDE": "{0}",
}
#: Rows of a large table that one task sorts and groups, and partitions from which they are asked for.
SPREAD_ROWS, SPREAD_LEAST = 250_000, 32
_SPREAD = re.compile(r"\{SPREAD:(\w+)~(\w+)\}")
#: Partitions up to which the engine writes a shuffle straight to a file each; beyond, a task holds what it deals out.
STRIDE = 200
_STRIDE = re.compile(r"\{STRIDE:(\w+)~([\w, ]+)\}")
#: Rows of a narrow table from which one task makes sentences, and partitions from which they are asked for.
DEAL_ROWS, DEAL_LEAST = 50_000, 8
_DEAL = re.compile(r"\{DEAL:(\w+)\}")
_MARK = re.compile(r"\{([A-Za-z]\w*)(?::([^{}]*))?\}")


def render(text: str, spark: bool, folder: str = "") -> str:
    """Fill placeholders, innermost first; ``{t:events}`` is a given table."""
    names = _SPARK if spark else _DUCK

    def one(m: re.Match) -> str:
        name, arg = m.group(1), m.group(2)
        if name == "t":
            return f"parquet.`{folder}/{arg}.parquet`" if spark else arg
        out = names[name]
        if arg is not None:
            for i, part in enumerate(arg.split("~")):
                out = out.replace(f"{{{i}}}", part)
        return out

    while True:
        done = _MARK.sub(one, text)
        if done == text:
            return done
        text = done


FRAMES: dict[str, str] = {
    # Sensor rows of all data formats; also time-ordered log rows.
    "sensor": """
SELECT event_id AS record_id, ts AS received_at, user_id % 8 AS stream_id,
 CAST(100 + event_id % 5 AS INT) AS data_format,
 {MDY:ts} AS measurement_date, {HMS:ts} AS measurement_time,
 CAST(event_id % 4 AS INT) AS error_code,
 lpad(CAST(event_id % 1000 AS {STR}), 8, '0') AS status_code,
 CAST((event_id * 37) % 3600 AS DOUBLE) / 10 AS heading,
 CAST((event_id * 13) % 400 AS DOUBLE) / 10 - 20 AS pitch,
 CAST((event_id * 7) % 600 AS DOUBLE) / 10 - 30 AS roll,
 value AS pressure,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 3) % 300 AS DOUBLE) / 10 END AS temperature,
 CAST(event_id % 310 AS DOUBLE) / 10 AS battery,
 CAST(1390 + event_id % 620 AS DOUBLE) AS sound_speed,
 'HEAD' || CAST(user_id % 40 AS {STR}) AS head_id,
 CASE user_id % 3 WHEN 0 THEN 'AQUADOPP' WHEN 1 THEN 'AQUADOPP_PROFILER' ELSE 'SIGNATURE' END
   AS instrument_type_name
FROM {t:events}""",
    # Log rows.
    "raw": """
SELECT event_id AS line_id, ts AS received_at, user_id % 8 AS stream_id,
 'HEAD' || CAST(user_id % 40 AS {STR}) AS head_id,
 '$' || CASE event_id % 4 WHEN 0 THEN 'PNORS' WHEN 1 THEN 'PNORC' WHEN 2 THEN 'PNORI' ELSE 'PNORW' END
   || ',' || {MDY:ts} || ',' || {HMS:ts} AS raw_sentence,
 CASE WHEN event_id % 13 = 0 THEN 'FAIL' WHEN event_id % 29 = 0 THEN 'PENDING' ELSE 'OK' END AS parse_status,
 CASE event_id % 4 WHEN 0 THEN 'PNORS' WHEN 1 THEN 'PNORC' WHEN 2 THEN 'PNORI' ELSE 'PNORW' END AS record_type,
 CASE WHEN event_id % 13 = 0 OR event_id % 29 = 0 THEN NULL ELSE event_id % 17 <> 0 END AS checksum_valid,
 CASE WHEN event_id % 13 = 0 THEN 'bad' END AS error_message
FROM {t:events}""",
    "errors": """
SELECT event_id AS line_id, ts AS received_at,
 CASE event_id % 3 WHEN 0 THEN 'PARSE_ERROR' WHEN 1 THEN 'BINARY_DATA' ELSE 'DECODE_ERROR' END AS error_type,
 event_type AS error_message,
 CASE event_id % 5 WHEN 0 THEN 'PNORS' WHEN 1 THEN 'PNORS1' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'PNORWD' END
   AS attempted_prefix
FROM {t:events}""",
    # Velocity cells.
    "cells": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS record_id, e.ts AS received_at, e.user_id % 8 AS stream_id,
 {MDY:e.ts} AS measurement_date, {HMS:e.ts} AS measurement_time,
 CAST(date_trunc('second', e.ts) AS TIMESTAMP{N}) AS measured_at,
 CAST(100 + e.event_id % 5 AS INT) AS data_format, l.l_linenumber AS cell_index,
 CASE WHEN l.l_orderkey % 3 = 0 THEN NULL ELSE 0.5 + l.l_linenumber * 1.0e0 END AS cell_distance,
 (MIN(l.l_quantity) - 25) / 25 AS vel1, MIN(l.l_discount) * 10 - 0.5 AS vel2, MIN(l.l_tax) AS vel3,
 CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE MAX(l.l_tax) END AS vel4,
 MAX(l.l_discount) AS speed, MIN(l.l_quantity) * 7 AS direction,
 MIN(l.l_quantity) AS amp1, MAX(l.l_quantity) AS amp2, MIN(l.l_quantity) + 1 AS amp3,
 CASE WHEN l.l_orderkey % 5 = 0 THEN NULL ELSE MAX(l.l_quantity) + 2 END AS amp4,
 CAST(COUNT(*) AS INT) AS corr1
FROM (SELECT {SPREAD:lineitem~seen_by}l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_orderkey % n + first AS seen_by
 FROM {STRIDE:lineitem~l_orderkey, l_linenumber, l_quantity, l_discount, l_tax} CROSS JOIN (SELECT COUNT(*) AS n, MIN(event_id) AS first FROM {t:events}) k) l
JOIN {t:events} e ON e.event_id = l.seen_by
GROUP BY l.l_orderkey, l.l_linenumber, e.ts, e.event_id, e.user_id""",
    # The same cells seen by a second instrument each, at the same times.
    "twin_cells": """
SELECT * FROM {f:cells} UNION ALL
SELECT -record_id, received_at, stream_id + 8, measurement_date, measurement_time, measured_at, data_format,
 cell_index, cell_distance, vel1 + 1, vel2, vel3 * 2, vel4, speed, direction, amp1 + 10, amp2, amp3 * 2, amp4, corr1
FROM {f:cells}""",
    # Seven vectors make one burst: energy, four coefficients, mean direction, spread.
    "spectra": """
SELECT vec_id AS record_id, vec_id {IDIV} 7 AS burst_no,
 CASE vec_id % 7 WHEN 0 THEN 'E' WHEN 1 THEN 'A1' WHEN 2 THEN 'B1' WHEN 3 THEN 'A2'
                 WHEN 4 THEN 'B2' WHEN 5 THEN 'MD' ELSE 'DS' END AS kind,
 {AT20:vec_id {IDIV} 7} AS received_at, {MDY:{AT20:vec_id {IDIV} 7}} AS measurement_date,
 {HMS:{AT20:vec_id {IDIV} 7}} AS measurement_time,
 1 AS spectrum_basis, 0.02e0 AS start_frequency, 0.01e0 AS step_frequency, 64 AS num_frequencies,
 {EACH}(embedding, {L:x} CASE vec_id % 7 WHEN 0 THEN abs(CAST(x AS DOUBLE))
   WHEN 5 THEN {PMOD:CAST(x AS DOUBLE)*720} WHEN 6 THEN abs(CAST(x AS DOUBLE))*80
   ELSE CAST(x AS DOUBLE) END) AS vals
FROM {t:embeddings}""",
    "energy": """
SELECT record_id, received_at, measurement_date, measurement_time, spectrum_basis, start_frequency,
 step_frequency, num_frequencies, vals AS energy_densities FROM {f:spectra} WHERE kind = 'E'""",
    "coefs": """
SELECT record_id, received_at, measurement_date, measurement_time, spectrum_basis, start_frequency,
 step_frequency, num_frequencies, kind AS coefficient_flag, vals AS coefficients
FROM {f:spectra} WHERE kind IN ('A1','B1','A2','B2')""",
    "dirs": """
SELECT record_id, received_at, measurement_date, measurement_time, spectrum_basis, start_frequency,
 step_frequency, num_frequencies, kind AS direction_type, vals AS "values"
FROM {f:spectra} WHERE kind IN ('MD','DS')""",
    "waves": """
SELECT burst_no AS record_id, received_at, measurement_date, measurement_time, spectrum_basis,
 1 AS processing_method, CAST(burst_no % 50 AS DOUBLE) / 10 AS hm0,
 CAST(burst_no % 17 AS DOUBLE) AS tp, CAST(burst_no * 31 % 360 AS DOUBLE) AS main_dir,
 '0000' AS wave_error_code
FROM {f:spectra} WHERE kind = 'E'""",
    "bands": """
SELECT record_id * 2 + k AS record_id, received_at, measurement_date, measurement_time,
 CAST(k AS INT) AS band, hm0 / (k + 1) AS hmo, tp, main_dir
FROM (SELECT *, {TWO} AS k FROM {f:waves} w) b""",
    "configs": """
SELECT s_suppkey AS config_id, TIMESTAMP{N} '2024-01-01 00:00:00' + {DAYS:CAST(s_suppkey % 7 AS INT)} AS received_at,
 s_suppkey % 8 AS stream_id,
 CASE WHEN s_suppkey % 3 = 0 THEN 100 WHEN s_suppkey % 3 = 1 THEN 101 ELSE 102 END AS data_format,
 'raw ' || s_name AS original_sentence,
 CASE s_nationkey % 3 WHEN 0 THEN 'AQUADOPP' WHEN 1 THEN 'AQUADOPP_PROFILER' ELSE 'SIGNATURE' END
   AS instrument_type_name,
 CASE s_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END AS instrument_type_code,
 s_name AS head_id, 4 AS beam_count, CAST(s_suppkey % 128 + 1 AS INT) AS cell_count,
 CAST(s_suppkey % 20 + 1 AS DOUBLE) / 10 AS blanking_distance,
 CAST(s_suppkey % 5 + 1 AS DOUBLE) / 2 AS cell_size,
 CASE s_nationkey % 3 WHEN 0 THEN 'ENU' WHEN 1 THEN 'XYZ' ELSE 'BEAM' END AS coord_system_name,
 CAST(s_nationkey % 3 AS INT) AS coord_system_code, 'AB' AS checksum
FROM {t:supplier}""",
    # Configurations over time: a sentence per stream now and then.
    "config_log": """
SELECT user_id % 8 AS stream_id, ts AS received_at,
 CAST(event_id % 20 + 1 AS DOUBLE) / 10 AS blanking_distance,
 CAST(event_id % 5 + 1 AS DOUBLE) / 2 AS cell_size
FROM {t:events}""",
    # Sentences with planted faults.
    "lines": """
SELECT event_id AS line_no, user_id % 8 AS stream_id, ts AS received_at,
 CASE WHEN event_id % 29 = 0 THEN 'garbage ' || CAST(event_id AS {STR})
 ELSE '$' || body || '*' || CASE WHEN event_id % 17 = 0 THEN '00' ELSE {XOR:body} END END AS raw_sentence
FROM (SELECT event_id, user_id, ts,
 CASE WHEN event_id % 23 = 0 THEN 'PXXXX' ELSE 'PNORS' END || ',' || {MDY:ts} || ',' || {HMS:ts} || ',0,' ||
 CASE WHEN event_id % 19 = 0 THEN 'BAD' ELSE '00000000' END || ',14.4,1523.0,' ||
 CAST((event_id * 37) % 3600 {IDIV} 10 AS {STR}) || '.' || CAST((event_id * 37) % 10 AS {STR}) ||
 ',' || CAST(event_id % 90 AS {STR}) || '.0,2.3,0.000,22.45,0,0' AS body FROM {DEAL:events}) b""",
    # Lines of every kind: sentences, and prose in four languages as what no parser knows.
    "mixed": """
SELECT line_no, raw_sentence FROM {f:lines}
UNION ALL SELECT -1 - doc_id AS line_no, text AS raw_sentence FROM {t:documents}""",
    # Averaged formats: header, sensor and cells in arrival order.
    "bursts34": """
SELECT event_id AS line_no, user_id % 8 AS stream_id,
 CASE event_id % 9 WHEN 0 THEN 'PNORH3' WHEN 1 THEN 'PNORS3' WHEN 5 THEN 'PNORH4' ELSE 'PNORC3' END AS record_type,
 {YMD:ts} AS d, {HMS:ts} AS t, lpad(CAST(event_id % 1000 AS {STR}), 8, '0') AS s
FROM {t:events}""",
    # The same as sentences; the speed of a cell tells the event it came from.
    "burst_lines": """
SELECT line_no, stream_id, '$' || CASE record_type
 WHEN 'PNORH3' THEN 'PNORH3,DATE=' || d || ',TIME=' || t || ',EC=0,SC=' || s
 WHEN 'PNORH4' THEN 'PNORH4,' || d || ',' || t || ',0,' || s
 WHEN 'PNORS3' THEN 'PNORS3,BV=22.9,SS=1546.1,H=151.1,PI=-12.0,R=-5.2,P=705.669,T=24.96'
 ELSE 'PNORC3,CP=1.5,SP=' || CAST(line_no % 1000000 {IDIV} 10000 AS {STR}) || '.' ||
  lpad(CAST(line_no % 10000 AS {STR}), 4, '0') || ',DIR=10.0,AA=5,AC=50' END AS raw_sentence
FROM {f:bursts34}""",
    "byte_lines": """
SELECT line_no, stream_id, is_bin, CASE WHEN is_bin THEN repeat(chr(1), 9) || chr(228) ELSE '$PNORX,' END || raw_sentence AS raw_sentence
FROM {f:blob_lines}""",
    # Binary and text lines in arrival order.
    "blob_lines": """
SELECT event_id AS line_no, user_id % 8 AS stream_id, ts AS received_at,
 event_type IN ('error','click') AS is_bin,
 CAST(event_id * 7919 AS {STR}) || event_type AS raw_sentence
FROM {t:events}""",
}


def _needs(name: str) -> list[str]:
    """Frames a frame is built on, in order, itself last."""
    out: list[str] = []
    for inner in re.findall(r"\{f:(\w+)\}", FRAMES[name]):
        out += [n for n in _needs(inner) if n not in out]
    return [*out, name]


def duck(frames: str, sql: str) -> str:
    """Oracle text: the frames as common table expressions, then the question."""
    order: list[str] = []
    for name in frames.split():
        order += [n for n in _needs(name) if n not in order]
    ctes = []
    for n in order:
        text = re.sub(r"\{f:(\w+)\}", r"\1", FRAMES[n])
        ctes.append(f"{n} AS ({render(text, False)})")
    head = f"WITH {', '.join(ctes)}\n" if ctes else ""
    return head + render(sql, False)


class Frames:
    """The frames of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _spread(self, table: str, column: str) -> str:
        """Hint that deals a large table to as many tasks as its rows need; the engine alone would
        give a task all that packs into one shuffle partition."""
        parts = self.table(table).count() // SPREAD_ROWS
        return f"/*+ REPARTITION({parts}, {column}) */ " if parts >= SPREAD_LEAST else ""

    def _stride(self, table: str, columns: str) -> str:
        """A table that ``_spread`` deals to very many tasks, dealt to fewer before that, so that those who
        deal have parts of it and not what a split of well packed rows holds."""
        parts = self.table(table).count() // SPREAD_ROWS
        if parts <= max(STRIDE, SPREAD_LEAST):
            return f"{{t:{table}}}"
        return f"(SELECT /*+ REPARTITION({STRIDE}, {columns}) */ {columns} FROM {{t:{table}}})"

    def _deal(self, table: str) -> str:
        """A large table dealt out by rows: its splits are few for their bytes, a sentence per row is much work."""
        parts = self.table(table).count() // DEAL_ROWS
        return f"(SELECT /*+ REPARTITION({parts}) */ * FROM {{t:{table}}})" if parts >= DEAL_LEAST else f"{{t:{table}}}"

    def sql(self, text: str) -> DataFrame:
        while "{f:" in text:
            text = re.sub(r"\{f:(\w+)\}", lambda m: f"({FRAMES[m.group(1)]})", text)
        text = _SPREAD.sub(lambda m: self._spread(*m.groups()), text)
        text = _STRIDE.sub(lambda m: self._stride(*m.groups()), text)
        text = _DEAL.sub(lambda m: self._deal(m.group(1)), text)
        return self.spark.sql(render(text, True, self.folder).replace('"values"', "`values`"))

    #: Frames written beforehand, so that a timing is of the operator and not of its test data.
    kept: dict[tuple[str, str], str] = {}

    def keep(self, path: str, *names: str) -> None:
        for name in names:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
            self.kept[self.folder, name] = f"{path}/{name}"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FRAMES:
            raise AttributeError(name)
        kept = self.kept.get((self.folder, name))
        return self.spark.read.parquet(kept) if kept else self.sql(FRAMES[name])
