"""Sentence layouts as data: 21 layouts, described field by field.

Nothing here parses.  A layout says which table a sentence feeds, in which order (or under
which tags) its fields come, and which limits hold.  ``plans.parse`` turns the registered
layouts into one small frame and evaluates them for a whole dataset at once; adding a layout
(``register_layout``) therefore adds a row of data, not a function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from decimal import Decimal

# How the text of one field is read.
INT, NUM, OPT, TEXT, UPPER, DATE_M, DATE_Y, TIME, HEX, HEAD, HEAD_N = range(11)

# Field order styles.
POSITIONAL, TAGGED, EITHER, SERIES = "positional", "tagged", "either", "series"

# What a repeated tag means: an error, the last one wins, or the last one wins but every
# occurrence has to be readable.
DUP_ERROR, DUP_LAST, DUP_EACH = "error", "last", "each"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: int
    sql_type: str | None  # None: parsed and checked, not stored in a typed column
    lo: float | None = None
    hi: float | None = None
    allowed: tuple[str, ...] = ()
    min_len: int = 0
    max_len: int = 0
    store_lo: float | None = None  # table rule, where narrower than the type itself
    store_hi: float | None = None
    store_allowed: tuple[str, ...] = ()
    tag: str | None = None

    def store_bounds(self) -> tuple[float | None, float | None]:
        """Smallest and largest parsed value whose stored (rounded) value the table accepts."""
        lo, hi, step = self.store_lo, self.store_hi, 0.0
        kind = (self.sql_type or "").lower()
        if kind.startswith("decimal"):
            precision, scale = (int(x) for x in kind[8:-1].split(","))
            step = 10.0**-scale
            top = 10.0 ** (precision - scale) - step
            lo, hi = (-top if lo is None else lo), (top if hi is None else hi)
        elif kind in _INT_BITS:
            top = 2.0 ** (_INT_BITS[kind] - 1)
            lo, hi = (-top if lo is None else lo), (top - 1 if hi is None else hi)
        if lo is None or hi is None:
            return lo, hi
        if step:  # half-up rounding: hi + step/2 already rounds past hi
            half = Decimal(str(step)) / 2
            above = math.nextafter(float(Decimal(str(hi)) + half), -math.inf)
            below = float(Decimal(str(lo)) - half)
            return (below if lo > 0 else math.nextafter(below, math.inf)), above
        return lo, hi


_INT_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


@dataclass(frozen=True)
class Layout:
    prefix: str
    table: str
    style: str
    fields: tuple[FieldSpec, ...]
    data_format: int | None = None
    duplicates: str = DUP_LAST
    synonyms: dict[str, str] = field(default_factory=dict)
    payload: str | None = None  # SERIES: name of the array column
    beam_rule: bool = False

    @property
    def year_first(self) -> bool:
        return any(f.kind == DATE_Y for f in self.fields)

    @property
    def dated(self) -> bool:
        return any(f.kind in (DATE_M, DATE_Y) for f in self.fields)

    @property
    def min_fields(self) -> int:
        """Field count with the prefix; a series needs at least one value."""
        return len(self.fields) + (2 if self.style == SERIES else 1)


# --------------------------------------------------------------------------- fixed values
# Field vocabulary: kind, storage type and accepted range of each field name.  Names repeat
# over layouts with the same meaning; the few exceptions are spelled out at the layout.
_VOCAB = {
    "measurement_date": dict(kind=DATE_M, sql_type="string"),
    "measurement_time": dict(kind=TIME, sql_type="string"),
    "error_code": dict(kind=INT, sql_type="int"),
    "status_code": dict(kind=HEX, sql_type="string", min_len=8, max_len=8),
    "battery": dict(kind=NUM, sql_type="decimal(4,1)", lo=0.0, hi=30.0),
    "sound_speed": dict(kind=NUM, sql_type="decimal(6,1)", lo=1400.0, hi=2000.0),
    "heading": dict(kind=NUM, sql_type="decimal(5,1)", lo=0.0, hi=360.0),
    "heading_std_dev": dict(kind=NUM, sql_type="decimal(5,1)"),
    "pitch": dict(kind=NUM, sql_type="decimal(4,1)", lo=-90.0, hi=90.0),
    "pitch_std_dev": dict(kind=NUM, sql_type="decimal(4,1)"),
    "roll": dict(kind=NUM, sql_type="decimal(5,1)", lo=-90.0, hi=90.0),
    "roll_std_dev": dict(kind=NUM, sql_type="decimal(5,1)"),
    "pressure": dict(kind=NUM, sql_type="decimal(7,3)", lo=0.0, hi=20000.0),
    "pressure_std_dev": dict(kind=NUM, sql_type="decimal(7,3)"),
    "temperature": dict(kind=NUM, sql_type="decimal(5,2)", lo=-5.0, hi=50.0),
    "analog1": dict(kind=INT, sql_type="smallint"),
    "analog2": dict(kind=INT, sql_type="smallint"),
    "cell_index": dict(kind=INT, sql_type="smallint", lo=1, hi=1000),
    "cell_distance": dict(kind=NUM, sql_type="decimal(8,3)", lo=0.0, hi=1000.0),
    "vel1": dict(kind=NUM, sql_type="decimal(8,4)", lo=-100.0, hi=100.0),
    "vel2": dict(kind=NUM, sql_type="decimal(8,4)", lo=-100.0, hi=100.0),
    "vel3": dict(kind=NUM, sql_type="decimal(8,4)", lo=-100.0, hi=100.0),
    "vel4": dict(kind=NUM, sql_type="decimal(8,4)", lo=-100.0, hi=100.0),
    "speed": dict(kind=NUM, sql_type="decimal(8,4)", lo=0.0, hi=100.0),
    "direction": dict(kind=NUM, sql_type="decimal(5,2)", lo=0.0, hi=360.0),
    "amp_unit": dict(kind=TEXT, sql_type="string", allowed=("C", "D")),
    "amp1": dict(kind=NUM, sql_type="decimal(6,2)", lo=0.0, hi=255.0),
    "amp2": dict(kind=NUM, sql_type="decimal(6,2)", lo=0.0, hi=255.0),
    "amp3": dict(kind=NUM, sql_type="decimal(6,2)", lo=0.0, hi=255.0),
    "amp4": dict(kind=NUM, sql_type="decimal(6,2)", lo=0.0, hi=255.0),
    "corr1": dict(kind=INT, sql_type="smallint", lo=0, hi=100),
    "corr2": dict(kind=INT, sql_type="smallint", lo=0, hi=100),
    "corr3": dict(kind=INT, sql_type="smallint", lo=0, hi=100),
    "corr4": dict(kind=INT, sql_type="smallint", lo=0, hi=100),
    "avg_amplitude": dict(kind=INT, sql_type="smallint", lo=0, hi=255),
    "avg_correlation": dict(kind=INT, sql_type="smallint", lo=0, hi=100),
    "instrument_type_code": dict(kind=INT, sql_type="tinyint", allowed=("0", "2", "4")),
    "head_id": dict(kind=HEAD_N, sql_type="string", min_len=1, max_len=20),
    "beam_count": dict(kind=INT, sql_type="tinyint", lo=1, hi=4),
    "cell_count": dict(kind=INT, sql_type="smallint", lo=1, hi=1000, store_lo=1, store_hi=128),
    "blanking_distance": dict(kind=NUM, sql_type="decimal(5,2)", lo=5e-324, hi=100.0,
                              store_lo=0.01, store_hi=100.0),
    "cell_size": dict(kind=NUM, sql_type="decimal(5,2)", lo=5e-324, hi=100.0,
                      store_lo=0.01, store_hi=100.0),
    "coord_system_name": dict(kind=UPPER, sql_type="string", allowed=("ENU", "XYZ", "BEAM")),
    "coord_system_code": dict(kind=INT, sql_type="tinyint", allowed=("0", "1", "2")),
    "altimeter_distance": dict(kind=NUM, sql_type="decimal(7,3)", lo=0.0, hi=999.999),
    "quality": dict(kind=INT, sql_type="int"),
    "status": dict(kind=HEX, sql_type="string", min_len=2, max_len=2),
    "spectrum_basis": dict(kind=INT, sql_type="tinyint", allowed=("0", "1", "3")),
    "processing_method": dict(kind=INT, sql_type="tinyint", lo=1, hi=4),
    "start_frequency": dict(kind=NUM, sql_type="decimal(5,2)", lo=0.0, hi=10.0,
                            store_lo=0.0, store_hi=10.0),
    "step_frequency": dict(kind=NUM, sql_type="decimal(5,2)", lo=0.0, hi=10.0,
                           store_lo=0.0, store_hi=10.0),
    "num_frequencies": dict(kind=INT, sql_type="smallint", lo=1, hi=999),
    "coefficient_flag": dict(kind=TEXT, sql_type="string", allowed=("A1", "B1", "A2", "B2")),
    "direction_type": dict(kind=TEXT, sql_type="string", allowed=("MD", "DS")),
    "freq_low": dict(kind=NUM, sql_type="decimal(4,2)", lo=0.0, hi=10.0,
                     store_lo=0.0, store_hi=9.99),
    "freq_high": dict(kind=NUM, sql_type="decimal(4,2)", lo=0.0, hi=10.0,
                      store_lo=0.0, store_hi=9.99),
    "hm0": dict(kind=OPT, sql_type="decimal(5,2)", lo=0.0, hi=100.0),
    "hmo": dict(kind=OPT, sql_type="decimal(5,2)", lo=0.0, hi=100.0,
                store_lo=0.0, store_hi=99.99),
    "h3": dict(kind=OPT, sql_type="decimal(5,2)"),
    "h10": dict(kind=OPT, sql_type="decimal(5,2)"),
    "hmax": dict(kind=OPT, sql_type="decimal(5,2)"),
    "tm02": dict(kind=OPT, sql_type="decimal(5,2)", lo=0.0, hi=100.0),
    "tp": dict(kind=OPT, sql_type="decimal(5,2)", lo=0.0, hi=100.0),
    "tz": dict(kind=OPT, sql_type="decimal(5,2)"),
    "dir_tp": dict(kind=OPT, sql_type="decimal(6,2)"),
    "spr_tp": dict(kind=OPT, sql_type="decimal(6,2)"),
    "dirtp": dict(kind=OPT, sql_type="decimal(5,2)", store_lo=0.0, store_hi=359.99),
    "sprtp": dict(kind=OPT, sql_type="decimal(5,2)", store_lo=0.0, store_hi=359.99),
    "main_dir": dict(kind=OPT, sql_type="decimal(6,2)"),
    "uni_index": dict(kind=OPT, sql_type="decimal(5,2)"),
    "mean_pressure": dict(kind=OPT, sql_type="decimal(5,2)"),
    "num_no_detects": dict(kind=INT, sql_type="int"),
    "num_bad_detects": dict(kind=INT, sql_type="int"),
    "near_surface_speed": dict(kind=OPT, sql_type="decimal(5,2)"),
    "near_surface_dir": dict(kind=OPT, sql_type="decimal(6,2)"),
    "wave_error_code": dict(kind=TEXT, sql_type="string"),
}

# Field orders shared by several layouts.
_CLOCK = "measurement_date measurement_time"
_CONFIG = ("instrument_type_code head_id beam_count cell_count blanking_distance cell_size "
           "coord_system_name")
_ATTITUDE = "battery sound_speed heading pitch roll pressure temperature"
_SENSOR = (_CLOCK + " error_code status_code battery sound_speed heading_std_dev heading pitch "
           "pitch_std_dev roll roll_std_dev pressure pressure_std_dev temperature")
_CELL = (_CLOCK + " cell_index cell_distance vel1 vel2 vel3 vel4 amp1 amp2 amp3 amp4 "
         "corr1 corr2 corr3 corr4")
_ALTIMETER = _CLOCK + " pressure altimeter_distance quality status pitch roll"
_AXIS = "spectrum_basis start_frequency step_frequency num_frequencies"

# Tags in the order of the fields above.
_CONFIG_TAGS = "IT SN NB NC BD CS CY"
_SENSOR_TAGS = "DATE TIME EC SC BV SS HSD H PI PISD R RSD P PSD T"
_ATTITUDE_TAGS = "BV SS H PI R P T"
_CELL_TAGS = "DATE TIME CN CP V1 V2 V3 V4 A1 A2 A3 A4 C1 C2 C3 C4"
_MEAN_CELL_TAGS = "CP SP DIR AA AC"
_HEADER_TAGS = "DATE TIME EC SC"
_ALTIMETER_TAGS = "DATE TIME P A Q ST PI R"
_VELOCITY_SYNONYMS = {
    "VE": "V1", "VN": "V2", "VU": "V3", "VU2": "V4",
    "VX": "V1", "VY": "V2", "VZ": "V3", "VZ2": "V4",
}

_YEAR_FIRST = {"measurement_date": dict(kind=DATE_Y)}
_SMALL_AMP = {f"amp{i}": dict(kind=INT, sql_type="smallint") for i in (1, 2, 3, 4)}


def fields_of(names: str, tags: str | None = None, **changes: dict) -> tuple[FieldSpec, ...]:
    """Field specs of a name list, with per-layout changes to the vocabulary."""
    labels = tags.split() if tags else [None] * len(names.split())
    return tuple(
        FieldSpec(name=n, tag=t, **{**_VOCAB[n], **changes.get(n, {})})
        for n, t in zip(names.split(), labels, strict=True)
    )


_LAYOUTS = [
    Layout("PNORI", "pnori", POSITIONAL, fields_of(
        _CONFIG.replace("coord_system_name", "coord_system_code"),
        head_id=dict(kind=HEAD, max_len=30)), 100, beam_rule=True),
    Layout("PNORI1", "pnori12", POSITIONAL, fields_of(_CONFIG), 101, beam_rule=True),
    Layout("PNORI2", "pnori12", TAGGED, fields_of(_CONFIG, _CONFIG_TAGS), 102,
           DUP_ERROR, beam_rule=True),
    Layout("PNORS", "pnors_df100", POSITIONAL, fields_of(
        f"{_CLOCK} error_code status_code {_ATTITUDE} analog1 analog2",
        error_code=dict(kind=HEX, sql_type="string", min_len=1, max_len=8)), 100),
    Layout("PNORS1", "pnors12", POSITIONAL, fields_of(_SENSOR), 101),
    Layout("PNORS2", "pnors12", TAGGED, fields_of(_SENSOR, _SENSOR_TAGS), 102),
    Layout("PNORS3", "pnors34", TAGGED, fields_of(_ATTITUDE, _ATTITUDE_TAGS), 103, DUP_EACH),
    Layout("PNORS4", "pnors34", POSITIONAL, fields_of(_ATTITUDE), 104),
    Layout("PNORC", "pnorc_df100", POSITIONAL, fields_of(
        f"{_CLOCK} cell_index vel1 vel2 vel3 vel4 speed direction amp_unit "
        "amp1 amp2 amp3 amp4 corr1 corr2 corr3 corr4", **_SMALL_AMP), 100),
    Layout("PNORC1", "pnorc12", POSITIONAL, fields_of(_CELL), 101),
    Layout("PNORC2", "pnorc12", TAGGED, fields_of(_CELL, _CELL_TAGS), 102, DUP_ERROR,
           _VELOCITY_SYNONYMS),
    Layout("PNORC3", "pnorc34", TAGGED, fields_of(
        "cell_distance speed direction avg_amplitude avg_correlation", _MEAN_CELL_TAGS),
        103, DUP_EACH),
    Layout("PNORC4", "pnorc34", POSITIONAL, fields_of(
        "cell_distance speed direction avg_correlation avg_amplitude"), 104),
    Layout("PNORH3", "pnorh", TAGGED, fields_of(
        f"{_CLOCK} error_code status_code", _HEADER_TAGS, **_YEAR_FIRST), 103, DUP_EACH),
    Layout("PNORH4", "pnorh", POSITIONAL, fields_of(
        f"{_CLOCK} error_code status_code", **_YEAR_FIRST), 104),
    Layout("PNORA", "pnora_data", EITHER, fields_of(
        _ALTIMETER, _ALTIMETER_TAGS, **_YEAR_FIRST,
        pressure=dict(hi=999.999), pitch=dict(lo=-9.9, hi=9.9),
        roll=dict(lo=-9.9, hi=9.9, sql_type="decimal(4,1)"))),
    Layout("PNORW", "pnorw_data", POSITIONAL, fields_of(
        f"{_CLOCK} spectrum_basis processing_method hm0 h3 h10 hmax tm02 tp tz dir_tp spr_tp "
        "main_dir uni_index mean_pressure num_no_detects num_bad_detects near_surface_speed "
        "near_surface_dir wave_error_code",
        spectrum_basis=dict(lo=0, hi=3, allowed=()))),
    Layout("PNORB", "pnorb_data", POSITIONAL, fields_of(
        f"{_CLOCK} spectrum_basis processing_method freq_low freq_high hmo tm02 tp dirtp sprtp "
        "main_dir wave_error_code",
        spectrum_basis=dict(lo=0, hi=3, allowed=(), store_allowed=("0", "1", "3")),
        tm02=dict(store_lo=0.0, store_hi=99.99), tp=dict(store_lo=0.0, store_hi=99.99),
        main_dir=dict(sql_type="decimal(5,2)", store_lo=0.0, store_hi=359.99))),
    Layout("PNORE", "pnore_data", SERIES, fields_of(
        f"{_CLOCK} {_AXIS}", num_frequencies=dict(store_lo=1, store_hi=99)),
        payload="energy_densities"),
    Layout("PNORF", "pnorf_data", SERIES, fields_of(f"coefficient_flag {_CLOCK} {_AXIS}"),
           payload="coefficients"),
    Layout("PNORWD", "pnorwd_data", SERIES, fields_of(f"direction_type {_CLOCK} {_AXIS}"),
           payload="values"),
]

# Markers of a missing measurement.
MISSING_MARKERS = ("-9.00", "-99.99", "-9.000", "-9.0000")

# Instrument and coordinate system codes.
INSTRUMENT_NAMES = {0: "AQUADOPP", 2: "AQUADOPP_PROFILER", 4: "SIGNATURE"}
COORDINATE_CODES = {"ENU": 0, "XYZ": 1, "BEAM": 2}

# Units of the columns that have one.
UNITS = {
    "temperature": "°C", "pressure": "dbar", "heading": "°", "pitch": "°", "roll": "°",
    "sound_speed": "m/s", "battery": "V", "vel1": "m/s", "vel2": "m/s", "vel3": "m/s",
    "vel4": "m/s", "speed": "m/s", "direction": "°", "distance": "m",
    "blanking_distance": "m", "cell_size": "m", "hm0": "m", "hmax": "m", "tp": "s",
    "tm02": "s", "mean_dir": "°", "peak_dir": "°", "directional_spread": "°",
    "altimeter_distance": "m", "start_frequency": "Hz", "step_frequency": "Hz",
}

# Group of each table.
CATEGORIES = {
    "pnori": "Configuration", "pnori12": "Configuration",
    "pnors_df100": "Sensor Data", "pnors12": "Sensor Data", "pnors34": "Sensor Data",
    "pnorc_df100": "Velocity Data", "pnorc12": "Velocity Data", "pnorc34": "Velocity Data",
    "pnorh": "Header Data", "pnore_data": "Wave Data", "pnorw_data": "Wave Data",
    "pnorb_data": "Wave Data", "pnorf_data": "Wave Data", "pnorwd_data": "Wave Data",
    "pnora_data": "Altitude Data", "raw_lines": "Raw Data", "parse_errors": "Errors",
}

# Lake folder of each table.
LAKE_TYPES = {
    "pnore_data": "PNORE", "pnorw_data": "PNORW", "pnorb_data": "PNORB",
    "pnorf_data": "PNORF", "pnorwd_data": "PNORWD", "pnora_data": "PNORA",
    "pnors_df100": "PNORS", "pnorc_df100": "PNORC", "pnors12": "PNORS12",
    "pnorc12": "PNORC12", "pnors34": "PNORS34", "pnorc34": "PNORC34", "pnorh": "PNORH",
    "pnori": "PNORI", "pnori12": "PNORI12", "parse_errors": "PARSE_ERRORS",
    "raw_lines": "RAW_LINES",
}

# Types with an error file of their own; every other rejected line shares one bucket.
ERROR_FILE_TYPES = ("PNORI", "PNORS", "PNORC", "PNORH", "PNORW", "PNORB", "PNORE", "PNORF",
                    "PNORWD", "PNORA")
# ------------------------------------------------------------------- end of fixed values

_registry: dict[str, Layout] = {layout.prefix: layout for layout in _LAYOUTS}
_version = 0


def register_layout(layout: Layout) -> None:
    """V1: add or replace the layout of one prefix."""
    global _version
    _registry[layout.prefix.upper()] = replace(layout, prefix=layout.prefix.upper())
    _version += 1


def unregister_layout(prefix: str) -> None:
    global _version
    _registry.pop(prefix.upper(), None)
    _version += 1


def version() -> int:
    """Changes whenever the set of layouts does."""
    return _version


def layouts() -> list[Layout]:
    return list(_registry.values())


def layouts_of(table: str) -> list[Layout]:
    return [layout for layout in _registry.values() if layout.table == table]


def tables() -> list[str]:
    return list(dict.fromkeys(layout.table for layout in _registry.values()))
