"""Lines of every layout made from the given events, and the values they should parse to."""

from __future__ import annotations

from brinelake import layouts as L

E = "event_id"


def _fixed(mult: int, mod: int, scale: int, add: int = 0) -> str:
    """Text of a decimal number that varies with the event."""
    n = f"(({E} * {mult}) % {mod} + {add})"
    if scale == 0:
        return f"CAST({n} AS {{STR}})"
    ten = 10**scale
    return (f"CAST({n} {{IDIV}} {ten} AS {{STR}}) || '.' || "
            f"lpad(CAST({n} % {ten} AS {{STR}}), {scale}, '0')")


def _signed(mult: int, mod: int, scale: int) -> str:
    return f"CASE WHEN {E} % 2 = 0 THEN '-' ELSE '' END || {_fixed(mult, mod, scale)}"


def _marked(every: int, text: str) -> str:
    """Optional value, missing now and then under one of the markers or as an empty field."""
    return (f"CASE WHEN {E} % {every} = 0 THEN CASE {E} % 4 WHEN 0 THEN '-9.00' WHEN 1 THEN '-99.99'"
            f" WHEN 2 THEN '-9.000' ELSE '' END ELSE {text} END")


_TEXTS = {
    "measurement_time": "{HMS:ts}",
    "error_code": _fixed(1, 7, 0),
    "status_code": f"lpad(CAST({E} % 10000 AS {{STR}}), 8, '2A')",
    "battery": _fixed(3, 300, 1),
    "sound_speed": _fixed(1, 4990, 1, 14010),
    "heading": _fixed(37, 3601, 1),
    "heading_std_dev": _fixed(5, 100, 1),
    "pitch": _signed(13, 900, 1),
    "pitch_std_dev": _fixed(3, 90, 1),
    "roll": _signed(7, 900, 1),
    "roll_std_dev": _fixed(9, 90, 1),
    "pressure": _fixed(1117, 9000000, 3),
    "pressure_std_dev": _fixed(17, 9000, 3),
    "temperature": _fixed(3, 3000, 2),
    "analog1": _fixed(1, 1000, 0),
    "analog2": _fixed(3, 77, 0),
    "cell_index": _fixed(1, 128, 0, 1),
    "cell_distance": _fixed(19, 900000, 3),
    "vel1": _signed(23, 90000, 3), "vel2": _signed(29, 90000, 3),
    "vel3": _signed(31, 90000, 3), "vel4": _signed(37, 90000, 3),
    "speed": _fixed(23, 90000, 3),
    "direction": _fixed(29, 36001, 2),
    "amp_unit": f"CASE WHEN {E} % 2 = 0 THEN 'C' ELSE 'D' END",
    "amp1": _fixed(31, 2551, 1), "amp2": _fixed(33, 2551, 1),
    "amp3": _fixed(35, 2551, 1), "amp4": _fixed(37, 2551, 1),
    "corr1": _fixed(3, 101, 0), "corr2": _fixed(5, 101, 0),
    "corr3": _fixed(7, 101, 0), "corr4": _fixed(11, 101, 0),
    "avg_amplitude": _fixed(5, 256, 0), "avg_correlation": _fixed(7, 101, 0),
    "instrument_type_code": f"CASE {E} % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE '4' END",
    "head_id": f"CAST({E} AS {{STR}})",
    "beam_count": f"CASE WHEN {E} % 3 = 2 THEN '4' ELSE CAST({E} % 3 + 1 AS {{STR}}) END",
    "cell_count": _fixed(1, 128, 0, 1),
    "blanking_distance": _fixed(7, 500, 2, 1),
    "cell_size": _fixed(11, 500, 2, 1),
    "coord_system_name": f"CASE {E} % 3 WHEN 0 THEN 'ENU' WHEN 1 THEN 'XYZ' ELSE 'BEAM' END",
    "coord_system_code": _fixed(1, 3, 0),
    "altimeter_distance": _fixed(41, 999999, 3),
    "quality": _fixed(1, 20000, 0),
    "status": f"lpad(CAST({E} % 100 AS {{STR}}), 2, '0')",
    "spectrum_basis": f"CASE {E} % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '3' END",
    "processing_method": _fixed(1, 4, 0, 1),
    "start_frequency": "'0.02'", "step_frequency": "'0.01'",
    "num_frequencies": _fixed(1, 40, 0, 1),
    "coefficient_flag": f"CASE {E} % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'B1' WHEN 2 THEN 'A2' ELSE 'B2' END",
    "direction_type": f"CASE {E} % 2 WHEN 0 THEN 'MD' ELSE 'DS' END",
    "freq_low": _fixed(3, 999, 2), "freq_high": _fixed(7, 999, 2),
    "hm0": _marked(13, _fixed(43, 9900, 2)), "hmo": _marked(13, _fixed(43, 9900, 2)),
    "h3": _marked(5, _fixed(47, 9900, 2)), "h10": _marked(6, _fixed(53, 9900, 2)),
    "hmax": _marked(7, _fixed(59, 9900, 2)), "tm02": _marked(8, _fixed(61, 9900, 2)),
    "tp": _marked(9, _fixed(67, 9900, 2)), "tz": _marked(10, _fixed(71, 9900, 2)),
    "dir_tp": _marked(11, _fixed(73, 36000, 2)), "spr_tp": _marked(12, _fixed(79, 9900, 2)),
    "dirtp": _marked(11, _fixed(73, 36000, 2)), "sprtp": _marked(12, _fixed(79, 9900, 2)),
    "main_dir": _marked(14, _fixed(83, 36000, 2)), "uni_index": _marked(15, _fixed(89, 100, 2)),
    "mean_pressure": _marked(16, _fixed(97, 90000, 2)),
    "num_no_detects": _fixed(1, 1000, 0), "num_bad_detects": _fixed(3, 1000, 0),
    "near_surface_speed": _marked(17, _fixed(101, 9900, 2)),
    "near_surface_dir": _marked(18, _fixed(103, 36000, 2)),
    "wave_error_code": f"lpad(CAST({E} % 100 AS {{STR}}), 4, '0')",
}
_CHANGED = {  # narrower ranges of single layouts
    ("PNORA", "pressure"): _fixed(1117, 900000, 3),
    ("PNORA", "pitch"): _signed(13, 99, 1),
    ("PNORA", "roll"): _signed(7, 99, 1),
    ("PNORC", "amp1"): _fixed(31, 256, 0), ("PNORC", "amp2"): _fixed(33, 256, 0),
    ("PNORC", "amp3"): _fixed(35, 256, 0), ("PNORC", "amp4"): _fixed(37, 256, 0),
    ("PNORI", "head_id"): f"'Sig_' || CAST({E} AS {{STR}})",
    ("PNORW", "mean_pressure"): _marked(16, _fixed(97, 9900, 2)),
}
_SERIES_ITEM = f"CASE WHEN ({E} + i) % 6 = 0 THEN '-9.00' ELSE CAST(({E} * 3 + i * 7) % 90 AS {{STR}}) || '.5' END"


def field_text(layout: L.Layout, f: L.FieldSpec) -> str:
    if f.name == "measurement_date":
        return "{YMD:ts}" if f.kind == L.DATE_Y else "{MDY:ts}"
    return _CHANGED.get((layout.prefix, f.name), _TEXTS[f.name])


def body_text(layout: L.Layout) -> str:
    """Sentence without ``$`` and checksum; tags forwards or backwards, spaced now and then."""
    texts = [field_text(layout, f) for f in layout.fields]
    plain = " || ',' || ".join([f"'{layout.prefix}'", *[f"({t})" for t in texts]])
    if layout.style == L.SERIES:
        return f"{plain} || ',' || {{SERIES:({E} % 40 + 1)~{_SERIES_ITEM}}}"
    if layout.style == L.POSITIONAL:
        return plain
    tagged = [f"'{f.tag}=' || ({t})" for f, t in zip(layout.fields, texts, strict=True)]
    forth = " || ',' || ".join([f"'{layout.prefix}'", *tagged])
    back = " || ',' || ".join([f"'{layout.prefix}'", *reversed(tagged)])
    if layout.style == L.EITHER:
        return f"CASE {E} % 3 WHEN 0 THEN {plain} WHEN 1 THEN {forth} ELSE {back} END"
    return f"CASE {E} % 2 WHEN 0 THEN {forth} ELSE {back} END"


def lines_sql(layout: L.Layout) -> str:
    """One line per event: every 19th lacks most fields, every 17th has a wrong checksum."""
    return f"""SELECT event_id AS line_no, ts AS received_at, user_id % 8 AS stream_id,
 '$' || body || '*' || CASE WHEN event_id % 17 = 0 THEN 'zz' ELSE {{XOR:body}} END AS raw_sentence
FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 19 = 0 THEN '{layout.prefix},1'
 ELSE {body_text(layout)} END AS body FROM {{DEAL:events}}) b"""


_CASTS = {L.INT: "BIGINT", L.NUM: "DOUBLE", L.OPT: "DOUBLE"}


def expected_sql(layout: L.Layout) -> str:
    """The typed values, straight from the field texts."""
    columns = ["event_id AS line_no", "event_id % 17 <> 0 AS checksum_valid"]
    for f in layout.fields:
        text = f"({field_text(layout, f)})"
        if f.kind == L.OPT:
            text = f"CASE WHEN {text} NOT IN ('', '-9.00', '-99.99', '-9.000') THEN {text} END"
        kind = _CASTS.get(f.kind)
        columns.append(f"CAST({text} AS {kind}) AS {f.name}" if kind else f"{text} AS {f.name}")
    if layout.payload:
        n = f"({E} % 40 + 1)"
        values = (f"list_transform(range({n}), lambda i: CASE WHEN ({E} + i) % 6 <> 0 THEN"
                  f" CAST(({E} * 3 + i * 7) % 90 AS DOUBLE) + 0.5 END)")
        columns += [f"len({values}) AS payload_size", f"coalesce(list_sum({values}), 0.0) AS payload_sum"]
    if layout.dated:
        columns.append("date_trunc('second', ts) AS measured_at")
    return f"SELECT {', '.join(columns)} FROM events WHERE event_id % 19 <> 0"
