"""Lines to one parsed frame, then to typed tables.

The registered layouts become small frames (a row per prefix, so their size is fixed by the
number of sentence types) that lines are joined to by prefix.  A plain sentence is settled by
one pattern match; all others are checked field by field against the joined rules with array
functions.  No shuffle and no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake import layouts as L
from brinelake.functions import sentences as S
from brinelake.functions.barrier import let, with_once
from brinelake.functions.patterns import MARKER, line_pattern

_FIELD = ("name string, kind int, lo double, hi double, allowed array<string>, min_len int, "
          "max_len int, store_lo double, store_hi double, store_allowed array<string>")
_ROUTE = ("prefix string, table_name string, style string, data_format int, year_first boolean, "
          "width int")
_RULES = ("rule_prefix string, duplicates string, beam_rule boolean, tags array<string>, "
          f"synonyms map<string,string>, rules array<struct<{_FIELD}>>")


def route_frame(spark: SparkSession) -> DataFrame:
    """Where each prefix goes; a row per registered layout."""
    return spark.createDataFrame(
        [(l.prefix, l.table, l.style, l.data_format, l.year_first, len(l.fields))
         for l in L.layouts()], _ROUTE)


def rule_frame(spark: SparkSession) -> DataFrame:
    """The field rules; a row per registered layout."""
    rows = []
    for layout in L.layouts():
        rules = []
        for f in layout.fields:
            store_lo, store_hi = f.store_bounds()
            rules.append((f.name, f.kind, _num(f.lo), _num(f.hi), list(f.allowed) or None,
                          f.min_len, f.max_len, _num(store_lo), _num(store_hi),
                          list(f.store_allowed) or None))
        rows.append((layout.prefix, layout.duplicates, layout.beam_rule,
                     [f.tag for f in layout.fields] if layout.fields[0].tag else None,
                     dict(layout.synonyms), rules))
    return spark.createDataFrame(rows, _RULES)


def _num(x: float | None) -> float | None:
    return None if x is None else float(x)


def parse_lines(
    lines: DataFrame,
    line: str = "raw_sentence",
    strict: bool = False,
    sentinel_mode: str = "exact",
    plain_first: bool = True,
) -> DataFrame:
    """Classify and parse lines; every input column is kept.

    Added columns: ``raw_sentence`` (as logged), ``record_type``, ``parse_status``,
    ``error_type``, ``error_message``, ``checksum``, ``checksum_expected``,
    ``checksum_valid``, ``table_name``, ``data_format``, ``year_first``, ``vals`` (field texts
    in layout order), ``nums`` (the numbers of numeric fields) and ``payload`` (the array of a
    series).  Empty lines are dropped.  ``strict`` rejects wrong checksums; ``sentinel_mode``
    ``le_minus_9`` treats every optional number of -9 or less as missing.  ``plain_first``
    settles plain sentences by one pattern match; without it every line goes through the field
    rules, with the same result.
    """
    if sentinel_mode not in ("exact", "le_minus_9"):
        raise ValueError(f"unknown sentinel_mode {sentinel_mode!r}")
    low = sentinel_mode == "le_minus_9"
    spark = lines.sparkSession
    kept = [c for c in lines.columns if c != line]

    step = _classified(lines, line, kept)
    step = step.join(F.broadcast(route_frame(spark)), F.col("_prefix") == F.col("prefix"),
                     "left").drop("prefix")
    plain, plain_result, checked_result = _expressions(spark, low)
    step = step.withColumn("_plain", plain if plain_first else F.lit(False))
    # Plain lines need no rules: their key is NULL and finds none.
    step = step.withColumn("_rule_key", F.when(~F.col("_plain"), F.col("_prefix")))
    step = step.join(F.broadcast(rule_frame(spark)), F.col("_rule_key") == F.col("rule_prefix"),
                     "left").drop("rule_prefix", "_rule_key")

    known = F.col("table_name").isNotNull()
    step = step.withColumns({
        "checksum": F.when(known, S.given_checksum("_line")),
        "checksum_expected": F.when(known & F.col("_line").contains("*"), S.checksum("_line"))})
    step = with_once(
        step, _got=F.when(F.col("_plain"), plain_result).when(known, checked_result))

    short_series = F.col("_plain") & (F.col("style") == L.SERIES) & F.col("_got.payload").isNull()
    refused = F.coalesce(F.col("_got.refused"), F.when(
        short_series, F.lit("Fewer values than announced")))
    wrong_sum = (F.col("checksum").isNotNull()
                 & (F.col("checksum") != F.col("checksum_expected")))
    error = (
        F.when(F.col("_binary"), _error("BINARY_DATA", F.lit("Binary data")))
        .when(F.col("_foreign"), _error("DECODE_ERROR", F.lit("Line is not ASCII text")))
        .when(F.col("_prefix").isNull(), _error("PARSE_ERROR", F.when(
            F.col("_line").startswith("$"), F.lit("No comma in the line"))
            .otherwise(F.lit("No '$' at the start of the line"))))
        .when(~known, _error(None, F.concat(F.lit("No parser for "), F.col("_prefix"))))
        .when(refused.isNotNull(), _error("PARSE_ERROR", refused)))
    if strict:
        error = error.when(wrong_sum, _error("CHECKSUM_FAILED", F.concat(
            F.lit("Checksum is "), F.col("checksum"), F.lit(", expected "),
            F.col("checksum_expected"))))
    error = error.when(F.col("_got.unstored").isNotNull(),
                       _error("CONSTRAINT_VIOLATION", F.col("_got.unstored")))
    step = step.withColumn("_error", error)

    ok = F.col("_error").isNull()
    return step.select(
        *kept,
        F.col("_line").alias("raw_sentence"),
        F.when(F.col("_prefix").isNotNull(), F.col("_prefix"))
        .when(~F.col("_binary") & ~F.col("_foreign"), F.lit("UNKNOWN")).alias("record_type"),
        F.when(ok, F.lit("OK")).when(F.col("_error.type").isNull(), F.lit("PENDING"))
        .otherwise(F.lit("FAIL")).alias("parse_status"),
        F.col("_error.type").alias("error_type"),
        F.col("_error.text").alias("error_message"),
        "checksum", "checksum_expected",
        F.when(ok & F.col("checksum").isNotNull(), ~wrong_sum).alias("checksum_valid"),
        "table_name", "data_format", "year_first",
        F.col("_got.vals").alias("vals"), F.col("_got.nums").alias("nums"),
        F.col("_got.payload").alias("payload"))


_built: dict[tuple, tuple[Column, Column, Column]] = {}


def _expressions(spark: SparkSession, low: bool) -> tuple[Column, Column, Column]:
    """The long expressions, built once per application and set of layouts: a stream would
    otherwise spend seconds per batch on putting the same text together."""
    key = (spark.sparkContext.applicationId, L.version(), low)
    if key not in _built:
        _built.clear()
        _built[key] = (_is_plain(low), _plain_result(), _checked_result(low))
    return _built[key]


def _error(kind: str | None, message: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("type"), message.alias("text"))


# ------------------------------------------------------------------- lines and prefixes
def _classified(lines: DataFrame, line: str, kept: list[str]) -> DataFrame:
    """``_line`` as logged, ``_binary``, ``_foreign`` and ``_prefix``; no blank lines.

    One search for anything but printable ASCII decides whether the bytes matter at all.
    """
    step = with_once(lines, _raw=F.col(line)) if line != "_raw" else lines
    blank = F.col("_raw").rlike(r"^[ \t\n\r\x0b\x0c\x1c-\x1f]*$")
    step = step.where(~(blank & ~S.is_binary(S.one_char_per_byte("_raw"))))
    step = step.select(*kept, "_raw", F.col("_raw").rlike(r"[^\x20-\x7E]").alias("_odd"))
    step = step.select(*kept, "_raw", "_odd", F.when(
        F.col("_odd"), S.one_char_per_byte("_raw")).otherwise(F.col("_raw")).alias("_text"))
    step = step.select(
        *kept, "_text", "_odd",
        (F.col("_odd") & S.is_binary("_text")).alias("_binary"),
        (F.col("_odd") & S.has_non_ascii("_text")).alias("_foreign"))
    step = step.select(
        *kept, "_binary", "_foreign",
        F.when(~F.col("_odd"), F.trim("_text"))
        .when(F.col("_binary") | F.col("_foreign"), S.readable("_text"))
        .otherwise(S.strip("_text")).alias("_line"))
    head = F.substring_index("_line", ",", 1)
    return step.select("*", F.when(
        ~F.col("_binary") & ~F.col("_foreign") & S.is_sentence("_line"),
        F.upper(F.substring(head, F.lit(2), F.length("_line")))).alias("_prefix"))


# --------------------------------------------------------------------- plain sentences
def _is_plain(low: bool) -> Column:
    """Lines settled by the pattern of their layout."""
    out = F.lit(False)
    for layout in L.layouts():
        optional = layout.style == L.SERIES or any(f.kind == L.OPT for f in layout.fields)
        if low and optional:
            continue  # the patterns know the exact markers only
        out = F.when(F.col("_prefix") == layout.prefix,
                     F.col("_line").rlike(line_pattern(layout))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _plain_result() -> Column:
    """Fields of a plain sentence: split, tags and markers cut off, numbers cast as one array."""
    text = F.substring_index("_line", "*", 1)
    untagged = F.when(F.col("style") == L.TAGGED, F.regexp_replace(text, r",[A-Z0-9]+=", ","))
    with_options = [l.prefix for l in L.layouts()
                    if l.style == L.SERIES or any(f.kind == L.OPT for f in l.fields)]
    unmarked = F.when(F.col("_prefix").isin(with_options), F.regexp_replace(
        text, rf",(?:{MARKER})(?=,|$)", ","))
    after_prefix = lambda t: F.split(F.substring(
        t, F.length("_prefix") + 3, F.length(t)), ",")
    width = F.col("width")

    def result(texts: Column, numbers: Column) -> Column:
        count = F.get(numbers, width - 1).cast("int")
        series = (F.col("style") == L.SERIES) & (F.size(numbers) - width >= count)
        return F.struct(
            F.slice(texts, F.lit(1), width).alias("vals"),
            F.slice(numbers, F.lit(1), width).alias("nums"),
            F.when(series, F.slice(numbers, width + 1, count)).alias("payload"),
            F.lit(None).cast("string").alias("refused"),
            F.lit(None).cast("string").alias("unstored"))

    return let(after_prefix(F.coalesce(untagged, text)), lambda texts: let(
        F.when(unmarked.isNotNull(), after_prefix(unmarked)).otherwise(texts)
        .try_cast("array<double>"), lambda numbers: result(texts, numbers)))


# ------------------------------------------------------------------------- field rules
def _checked_result(low: bool) -> Column:
    """Every other sentence: fields by place or tag, and the first rule each one breaks."""
    loose = F.col("style") == L.EITHER
    raw_tag = lambda f: F.substring_index(f, "=", 1)
    tag = lambda f: F.when(loose, raw_tag(f)).otherwise(F.upper(S.strip(raw_tag(f))))
    text = lambda f: f.substr(F.length(raw_tag(f)) + 2, F.length(f))

    def from_fields(fields: Column) -> Column:
        rest = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))
        return let(rest, lambda r: from_rest(F.get(fields, F.lit(0)), r))

    def from_rest(first: Column, rest: Column) -> Column:
        tagged = (F.col("style") == L.TAGGED) | (
            loose & F.exists(rest, lambda f: f.contains("=")))
        pairs = F.when(loose, F.filter(rest, lambda f: f.contains("="))).otherwise(rest)
        found = F.reverse(F.transform(pairs, lambda f: F.struct(  # last occurrence first
            tag(f).alias("raw"), F.coalesce(F.try_element_at("synonyms", tag(f)), tag(f)).alias("tag"),
            F.when(loose, text(f)).otherwise(S.strip(text(f))).alias("v"))))
        return let(F.when(tagged, found), lambda t: let(
            F.when(t.isNotNull(), F.transform("tags", lambda name: F.get(
                t["v"], (F.array_position(t["tag"], name) - 1).cast("int"))))
            .otherwise(F.slice(rest, F.lit(1), F.col("width"))),
            lambda vals: read(first, rest, vals, t)))

    def read(first: Column, rest: Column, vals: Column, tags: Column) -> Column:
        read_one = lambda v, r: F.struct(
            v.alias("v"), _reading(F.when(loose, S.strip(v)).otherwise(v), r, low).alias("n"),
            r.alias("r"))
        return let(F.zip_with(vals, F.slice("rules", F.lit(1), F.size(vals)), read_one),
                   lambda fields: result(first, rest, vals, fields, tags))

    def result(first, rest, vals, fields, tags) -> Column:
        count = F.get(fields["n"], F.col("width") - 1)
        have = F.size(rest) - F.col("width")
        whole = (F.col("style") == L.SERIES) & count.between(1, 999) & (have >= count)
        payload = F.transform(
            F.slice(rest, F.col("width") + 1, F.when(whole, count.cast("int")).otherwise(0)),
            lambda v: S.optional_number(v, L.MISSING_MARKERS, low))
        first_of = lambda problems: F.get(
            F.filter(problems, lambda p: p.isNotNull()), F.lit(0))
        return F.struct(
            vals.alias("vals"), fields["n"].alias("nums"),
            F.when(whole, payload).alias("payload"),
            F.coalesce(_shape_problem(first, rest, count, have, tags),
                       first_of(F.transform(fields, _field_problem)),
                       F.when(F.col("beam_rule"), _beam_problem(fields["n"]))).alias("refused"),
            first_of(F.transform(fields, _store_problem)).alias("unstored"))

    return let(S.split_fields("_line"), from_fields)


def _reading(v: Column, r: Column, low: bool) -> Column:
    return (F.when(r["kind"] == L.NUM, S.number(v))
            .when(r["kind"] == L.INT, S.whole_number(v))
            .when(r["kind"] == L.OPT, S.optional_number(v, L.MISSING_MARKERS, low)))


def _shape_problem(first: Column, rest: Column, count: Column, have: Column,
                   tags: Column) -> Column:
    """Wrong prefix spelling, field count or tag set."""
    size, width = F.size(rest) + 1, F.col("width")
    style = F.col("style")
    text = lambda n: n.cast("bigint").cast("string")
    spelled = F.when(first != F.concat(F.lit("$"), F.col("_prefix")),
                     F.concat(F.lit("Invalid prefix: "), first))
    series = (
        F.when(size < width + 2, F.concat(
            F.lit("Expected at least "), text(width + 2), F.lit(" fields, got "), text(size)))
        .when(count > have, F.concat(
            F.lit("Expected "), text(count), F.lit(" values, got "), text(have))))
    counted = F.when(size != width + 1, F.concat(
        F.lit("Expected "), text(width + 1), F.lit(" fields, got "), text(size)))

    repeated = F.size(F.array_distinct(tags["raw"])) < F.size(tags)
    unknown = F.array_except(tags["tag"], F.col("tags"))
    lost = F.array_except(F.col("tags"), tags["tag"])
    unread = F.exists(tags, lambda p: (_rule_of(p["tag"])["kind"] <= L.NUM)
                      & _reading(p["v"], _rule_of(p["tag"]), False).isNull())
    tagged = (
        F.when((style == L.TAGGED) & F.exists(rest, lambda f: ~f.contains("=")),
               F.lit("Tagged field without '='"))
        .when((F.col("duplicates") == L.DUP_ERROR) & repeated, F.lit("Duplicate tag"))
        .when((style == L.TAGGED) & (F.size(unknown) > 0),
              F.concat(F.lit("Unknown tags: "), F.array_join(unknown, ", ")))
        .when(F.size(lost) > 0, F.concat(F.lit("Missing tags: "), F.array_join(lost, ", ")))
        .when((F.col("duplicates") == L.DUP_EACH) & repeated & unread,
              F.lit("Unreadable repeated tag")))
    return F.coalesce(spelled, F.when(tags.isNotNull(), tagged)
                      .when(style == L.SERIES, series).otherwise(counted))


def _rule_of(tag: Column) -> Column:
    return F.get("rules", (F.array_position("tags", tag) - 1).cast("int"))


def _says(r: Column, what: str, v: Column) -> Column:
    return F.concat(r["r"]["name"], F.lit(f" {what}: "), v)


def _field_problem(r: Column) -> Column:
    """Form, range and choice of one field; NULL where it is fine."""
    v, n, rule = r["v"], r["n"], r["r"]
    kind = rule["kind"]
    whole = n.cast("decimal(38,0)").cast("string")
    number_problem = (
        F.when(n.isNull() & (kind != L.OPT), _says(r, "is not a number", v))
        .when((n < rule["lo"]) | (n > rule["hi"]), _says(r, "is out of range", v))
        .when(rule["allowed"].isNotNull() & ~F.array_contains(rule["allowed"], whole),
              _says(r, "is not a valid code", v)))
    sized = F.length(v).between(rule["min_len"], rule["max_len"])
    wrong_form = (
        F.when(kind == L.DATE_M, ~v.rlike(S.DATE_M_PATTERN))
        .when(kind == L.TIME, ~v.rlike(S.TIME_PATTERN))
        .when(kind == L.DATE_Y, ~v.rlike(S.DATE_Y_PATTERN))
        .when(kind == L.HEX, ~(v.rlike("^[0-9A-Fa-f]+$") & sized))
        .when(kind == L.HEAD, ~(v.rlike("^[A-Za-z0-9_]+$") & sized))
        .when(kind == L.HEAD_N, ~(v.rlike("^[0-9]+$") & sized))
        .when(rule["allowed"].isNotNull(), ~F.array_contains(
            rule["allowed"], F.when(kind == L.UPPER, F.upper(v)).otherwise(v))))
    return (F.when(v.isNull(), F.concat(rule["name"], F.lit(" is missing")))
            .when(kind <= L.OPT, number_problem)
            .when(wrong_form, _says(r, "is invalid", v)))


def _store_problem(r: Column) -> Column:
    """The value does not fit the table, although the sentence is well formed."""
    n, rule = r["n"], r["r"]
    return F.when((n < rule["store_lo"]) | (n > rule["store_hi"]),
                  _says(r, "does not fit its table", r["v"])).when(
        rule["store_allowed"].isNotNull() & ~F.array_contains(
            rule["store_allowed"], n.cast("decimal(38,0)").cast("string")),
        _says(r, "is not accepted by its table", r["v"]))


def _beam_problem(nums: Column) -> Column:
    code, beams = F.get(nums, F.lit(0)), F.get(nums, F.lit(2))
    fits = F.when(code == 4, beams == 4).otherwise(beams.between(1, 3))
    return F.when(~fits, F.concat(
        F.lit("beam_count does not suit the instrument: "), beams.cast("int").cast("string")))


# ----------------------------------------------------------------------------- outputs
def raw_lines(parsed: DataFrame) -> DataFrame:
    """One row per logged line; undecodable lines are only in ``parse_errors``."""
    extra = [c for c in ("line_id", "stream_id", "received_at") if c in parsed.columns]
    return parsed.where("error_type IS NULL OR error_type <> 'DECODE_ERROR'").select(
        *extra, "raw_sentence", "parse_status", "record_type", "checksum_valid", "error_message")


def parse_errors(parsed: DataFrame) -> DataFrame:
    """The dead-letter rows, with expected and actual checksum where that was the reason."""
    extra = [c for c in ("line_id", "stream_id", "received_at") if c in parsed.columns]
    summed = F.col("error_type") == "CHECKSUM_FAILED"
    return parsed.where("error_type IS NOT NULL").select(
        *extra, "raw_sentence", "error_type", "error_message",
        F.col("record_type").alias("attempted_prefix"),
        F.when(summed, F.col("checksum_expected")).alias("checksum_expected"),
        F.when(summed, F.col("checksum")).alias("checksum_actual"))


def typed_table(parsed: DataFrame, table: str) -> DataFrame:
    """The rows of one table with their storage columns and types.

    A table is fed by one or two layouts.  Where the two agree on the place of a column it is
    read straight from that place, otherwise the place depends on the record type.
    """
    fed_by = L.layouts_of(table)
    if not fed_by:
        raise ValueError(f"no layout feeds {table!r}")
    names = list(dict.fromkeys(f.name for layout in fed_by for f in layout.fields if f.sql_type))
    extra = [c for c in ("line_id", "stream_id", "received_at") if c in parsed.columns]
    carried = "carried_date" in parsed.columns and not fed_by[0].dated

    columns: list[Column] = [F.col(c) for c in extra]
    if "line_id" in extra:  # what joins and ties of the operators go by
        columns.append(F.col("line_id").alias("record_id"))
    columns.append(F.col("raw_sentence").alias("original_sentence"))
    columns.append(F.col("record_type").alias("sentence_type"))
    if all((layout.data_format or 0) > 100 for layout in fed_by):
        columns.append(F.col("data_format"))
    if carried:
        columns += [F.col("carried_date").alias("measurement_date"),
                    F.col("carried_time").alias("measurement_time")]
        if table == "pnorc34":
            columns.append(F.col("cell_index").cast("smallint"))
    for name in names:
        columns.append(_storage_column(fed_by, name).alias(name))
        if name == "instrument_type_code":
            columns.append(code_name(_storage_column(fed_by, name), L.INSTRUMENT_NAMES)
                           .alias("instrument_type_name"))
    if "coord_system_name" in names:
        columns.append(name_code(_storage_column(fed_by, "coord_system_name"), L.COORDINATE_CODES)
                       .cast("tinyint").alias("coord_system_code"))
    elif "coord_system_code" in names:
        back = {code: name for name, code in L.COORDINATE_CODES.items()}
        columns.append(code_name(_storage_column(fed_by, "coord_system_code"), back)
                       .alias("coord_system_name"))
    payload = next((layout.payload for layout in fed_by if layout.payload), None)
    if payload:
        columns.append(F.col("payload").alias(payload))
    columns.append(F.col("checksum"))
    rows = parsed.where((F.col("table_name") == table) & (F.col("parse_status") == "OK"))
    typed = rows.select(*columns)
    if "measurement_date" in typed.columns:
        year_first = fed_by[0].year_first or carried
        typed = typed.withColumns({
            "measurement_id": S.measurement_id("measurement_date", "measurement_time"),
            "measured_at": S.measured_at("measurement_date", "measurement_time", year_first)})
    return typed


def typed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """A3: every typed table of one parsed frame."""
    return {table: typed_table(parsed, table) for table in L.tables()}


def _storage_column(fed_by: list[L.Layout], name: str) -> Column:
    places: dict[tuple[int, int, str], list[str]] = {}
    for layout in fed_by:
        for i, f in enumerate(layout.fields):
            if f.name == name:
                places.setdefault((i, f.kind, f.sql_type or "string"), []).append(layout.prefix)
    out = None
    for (i, kind, sql_type), prefixes in places.items():
        value = F.get("nums" if kind <= L.OPT else "vals", F.lit(i))
        if kind == L.UPPER:
            value = F.upper(value)
        value = value.try_cast(sql_type)
        if len(places) > 1 or len(prefixes) < len(fed_by):
            chosen = F.col("record_type").isin(prefixes)
            out = F.when(chosen, value) if out is None else out.when(chosen, value)
        else:
            out = value
    return out


def code_name(code: Column, names: dict[int, str]) -> Column:
    """Code to name."""
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def name_code(name: Column, codes: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for text, code in codes.items():
        out = F.when(F.upper(name) == text, F.lit(code)).otherwise(out)
    return out
