"""Lines: line-level operators (P1-P25) and the 21 layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinelake import layouts as L
from brinelake.functions import sentences as S
from brinelake.plans import parse as P
from driver_queries import sentence_lines as SL
from driver_queries.frames import duck
from driver_queries.registry import ORACLES, query

_ODD_BYTES = ("len(list_filter(regexp_extract_all(substr(hex(encode({c})), 1, 2048), '..'),"
              " lambda b: NOT (b BETWEEN '20' AND '7E' OR b IN ('0A', '0D'))))")


def _binary(c: str) -> str:
    return f"({_ODD_BYTES.replace('{c}', c)} > least(strlen({c}), 1024) // 10)"


@query("p01_binary", "", f"SELECT doc_id, {_binary('text')} AS is_binary FROM documents")
def _(f):
    rows = f.table("documents").select("doc_id", S.one_char_per_byte("text").alias("t"))
    return rows.select("doc_id", S.is_binary("t").alias("is_binary"))


@query("p02_non_ascii", "", "SELECT doc_id, strlen(text) <> length(text) AS non_ascii FROM documents")
def _(f):
    return f.table("documents").select("doc_id", S.has_non_ascii("text").alias("non_ascii"))


@query("p03_trimmed", "lines", """SELECT line_no, raw_sentence FROM lines WHERE line_no % 5 <> 0""")
def _(f):
    blank = F.concat(F.lit(" \t\x0b"), F.when(F.col("line_no") % 5 != 0, F.col("raw_sentence")).otherwise(""),
                     F.lit("\r "))
    rows = f.lines.select("line_no", S.strip(blank).alias("raw_sentence"))
    return rows.where("raw_sentence <> ''")


@query("p04_prefix", "lines", """SELECT line_no, CASE WHEN starts_with(raw_sentence, '$')
 THEN upper(substring(raw_sentence, 2, position(',' IN raw_sentence) - 2)) END AS prefix FROM lines""")
def _(f):
    return f.lines.select("line_no", S.prefix("raw_sentence").alias("prefix"))


@query("p05_fields", "lines", """SELECT line_no, len(string_split(regexp_replace(raw_sentence, '[*][^*]*$', ''), ',')) AS field_count,
 string_split(regexp_replace(raw_sentence, '[*][^*]*$', ''), ',')[8] AS eighth,
 CASE WHEN contains(raw_sentence, '*') THEN upper(trim(string_split(raw_sentence, '*')[-1])) END AS checksum FROM lines""")
def _(f):
    fields = S.split_fields("raw_sentence")
    return f.lines.select("line_no", F.size(fields).cast("bigint").alias("field_count"),
                          F.get(fields, F.lit(7)).alias("eighth"), S.given_checksum("raw_sentence").alias("checksum"))


_SUM = "{XOR:regexp_replace(string_split(raw_sentence, '*')[1], '^[$]', '')}"


@query("p06_checksum", "lines", f"SELECT line_no, {_SUM} AS checksum FROM lines")
def _(f):
    return f.lines.select("line_no", S.checksum("raw_sentence").alias("checksum"))


@query("p07_checksum_valid", "lines", f"""SELECT line_no, CASE WHEN contains(raw_sentence, '*') THEN
 {_SUM} = upper(trim(string_split(raw_sentence, '*')[-1])) END AS valid FROM lines""")
def _(f):
    return f.lines.select("line_no", S.checksum_valid("raw_sentence").alias("valid"))


@query("p14_sentinels", "", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS exact,
 CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN NULL ELSE value END AS documented FROM events""")
def _(f):
    text = F.when(F.col("event_id") % 3 == 0, F.get(F.array(*[F.lit(m) for m in (*L.MISSING_MARKERS, "", "n/a")]),
                  (F.col("event_id") % 6).cast("int"))).otherwise(F.col("value").cast("string"))
    low = F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 5 == 0), F.lit("-12.5")).otherwise(text)
    rows = f.table("events").select("event_id", text.alias("t"), low.alias("low"))
    return rows.select("event_id", S.optional_number("t", L.MISSING_MARKERS).alias("exact"),
                       S.optional_number("low", L.MISSING_MARKERS, True).alias("documented"))


@query("p17_validators", "", """SELECT o_orderkey, try_strptime(d, '%m%d%y') IS NOT NULL AS is_mdy,
 try_strptime(d, '%y%m%d') IS NOT NULL AS is_ymd, try_strptime(d, '%H%M%S') IS NOT NULL AS is_time
 FROM (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS d FROM orders)""")
def _(f):
    d = F.lpad(((F.col("o_orderkey") * 7919) % 1000000).cast("string"), 6, "0")
    return f.table("orders").select(
        "o_orderkey", d.rlike(S.DATE_M_PATTERN).alias("is_mdy"), d.rlike(S.DATE_Y_PATTERN).alias("is_ymd"),
        d.rlike(S.TIME_PATTERN).alias("is_time"))


# The status rules again, as plain conditions on the generated lines and on the prose.
_STATUS = f"""CASE WHEN line_no < 0 THEN CASE WHEN {_binary('raw_sentence')} THEN 'BINARY_DATA'
  WHEN strlen(raw_sentence) <> length(raw_sentence) THEN 'DECODE_ERROR' ELSE 'PARSE_ERROR' END
 WHEN line_no % 29 = 0 THEN 'PARSE_ERROR' WHEN line_no % 23 = 0 THEN NULL WHEN line_no % 19 = 0 THEN 'PARSE_ERROR' END"""


@query("p11_duplicate_tags", "", """SELECT event_id AS line_no, CASE event_id % 3 WHEN 0 THEN 'OK' ELSE 'FAIL' END AS parse_status,
 CASE WHEN event_id % 3 = 0 THEN (event_id % 900) / 10 END AS speed FROM events""")
def _(f):
    """A tag given twice: the last counts in some layouts, others reject the line."""
    lines = f.sql("""SELECT event_id AS line_no, CASE event_id % 3
     WHEN 0 THEN concat('$PNORC3,CP=2.5,SP=77.7,SP=', CAST((event_id % 900) / 10 AS DECIMAL(5,1)), ',DIR=12.0,AA=5,AC=50')
     WHEN 1 THEN '$PNORI2,IT=4,SN=77,NB=4,NC=25,BD=0.40,CS=2.00,CY=ENU,CY=XYZ'
     ELSE '$PNORC2,DATE=061722,TIME=071850,CN=1,CN=2,CP=3.0,VE=0.1,VN=0.1,VU=0.1,VU2=0.1,A1=50,A2=50,A3=50,A4=50,C1=60,C2=60,C3=60,C4=60'
     END AS raw_sentence FROM {t:events}""")
    parsed = P.parse_lines(lines).withColumn("line_id", F.col("line_no"))
    speed = P.typed_table(parsed.withColumns({"carried_date": F.lit("061722"), "carried_time": F.lit("071850"), "cell_index": F.lit(1)}),
                          "pnorc34").select(F.col("line_id").alias("line_no"), F.col("speed").cast("double").alias("speed"))
    return parsed.select("line_no", "parse_status").join(speed, "line_no", "left")


@query("p12_velocity_tags", "", """SELECT event_id AS line_no, (event_id % 100) / 100 AS vel1, (event_id % 90) / 100 AS vel2,
 -(event_id % 80) / 100 AS vel3, (event_id % 70) / 100 AS vel4 FROM events""")
def _(f):
    """Every spelling of the four velocity tags lands in the same columns."""
    lines = f.sql("""SELECT event_id AS line_no, concat('$PNORC2,DATE=061722,TIME=071850,CN=1,CP=3.0,', t[0], '=', v[0], ',', t[1], '=', v[1],
     ',', t[2], '=', v[2], ',', t[3], '=', v[3], ',A1=50,A2=50,A3=50,A4=50,C1=60,C2=60,C3=60,C4=60') AS raw_sentence FROM (SELECT event_id,
     CASE event_id % 3 WHEN 0 THEN array('VE', 'VN', 'VU', 'VU2') WHEN 1 THEN array('VX', 'VY', 'VZ', 'VZ2') ELSE array('V1', 'V2', 'V3', 'V4') END AS t,
     transform(array(event_id % 100, event_id % 90, -(event_id % 80), event_id % 70), x -> CAST(CAST(x / 100 AS DECIMAL(5,2)) AS STRING)) AS v
     FROM {t:events}) e""")
    typed = P.typed_table(P.parse_lines(lines).withColumn("line_id", F.col("line_no")), "pnorc12")
    return typed.select(F.col("line_id").alias("line_no"), *[F.round(F.col(f"vel{k}").cast("double"), 6).alias(f"vel{k}") for k in (1, 2, 3, 4)])


@query("p19_classify", "mixed", f"""SELECT line_no, error_type,
 CASE WHEN error_type IS NOT NULL THEN 'FAIL' WHEN line_no % 23 = 0 THEN 'PENDING' ELSE 'OK' END AS parse_status,
 CASE WHEN error_type IN ('BINARY_DATA', 'DECODE_ERROR') THEN NULL WHEN line_no < 0 OR line_no % 29 = 0 THEN 'UNKNOWN'
  WHEN line_no % 23 = 0 THEN 'PXXXX' ELSE 'PNORS' END AS record_type,
 CASE WHEN error_type IS NULL AND line_no % 23 <> 0 THEN line_no % 17 <> 0 END AS checksum_valid
 FROM (SELECT line_no, {_STATUS} AS error_type FROM mixed)""")
def _(f):
    return P.parse_lines(f.mixed).select("line_no", "error_type", "parse_status", "record_type", "checksum_valid")


@query("p19_strict", "lines", """SELECT error_type, count(*) AS n FROM (SELECT CASE WHEN line_no % 29 = 0 THEN 'PARSE_ERROR'
 WHEN line_no % 23 = 0 THEN NULL WHEN line_no % 19 = 0 THEN 'PARSE_ERROR' WHEN line_no % 17 = 0 THEN 'CHECKSUM_FAILED' END AS error_type
 FROM lines) GROUP BY 1""")
def _(f):
    return P.parse_lines(f.lines, strict=True).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("p18_constraints", "", """SELECT event_id AS line_no, CASE WHEN event_id % 1200 > 1000 OR event_id % 1200 = 0 THEN 'PARSE_ERROR'
 WHEN event_id % 1200 > 128 THEN 'CONSTRAINT_VIOLATION' END AS error_type FROM events""")
def _(f):
    lines = f.table("events").select(F.col("event_id").alias("line_no"), F.concat(
        F.lit("$PNORI,4,Head,4,"), (F.col("event_id") % 1200).cast("string"), F.lit(",0.20,1.00,0")).alias("raw_sentence"))
    return P.parse_lines(lines).select("line_no", "error_type")


@query("p20_raw_lines", "lines", """SELECT parse_status, record_type, checksum_valid, count(*) AS n FROM (SELECT
 CASE WHEN line_no % 29 = 0 OR (line_no % 19 = 0 AND line_no % 23 <> 0) THEN 'FAIL' WHEN line_no % 23 = 0 THEN 'PENDING' ELSE 'OK' END AS parse_status,
 CASE WHEN line_no % 29 = 0 THEN 'UNKNOWN' WHEN line_no % 23 = 0 THEN 'PXXXX' ELSE 'PNORS' END AS record_type,
 CASE WHEN parse_status = 'OK' THEN line_no % 17 <> 0 END AS checksum_valid FROM lines) GROUP BY ALL""")
def _(f):
    return P.raw_lines(P.parse_lines(f.lines)).groupBy("parse_status", "record_type", "checksum_valid").agg(
        F.count(F.lit(1)).alias("n"))


@query("p22_measurement_id", "sensor", """SELECT record_id, CAST(measurement_date || measurement_time AS BIGINT) AS measurement_id,
 date_trunc('second', received_at) AS measured_at FROM sensor""")
def _(f):
    return f.sensor.select("record_id", S.measurement_id("measurement_date", "measurement_time").alias("measurement_id"),
                           S.measured_at("measurement_date", "measurement_time").alias("measured_at"))


def _config_line(kind: str) -> str:
    names = ["instrument_type_code", "head_id", "beam_count", "cell_count", "blanking_distance", "cell_size",
             "coord_system_code" if kind == "PNORI" else "coord_system_name"]
    texts = [f"printf('%.2f', {n})" if n in ("blanking_distance", "cell_size") else f"CAST({n} AS VARCHAR)" for n in names]
    if kind == "PNORI2":
        texts = [f"'{t}=' || {x}" for t, x in zip("IT SN NB NC BD CS CY".split(), texts, strict=True)]
    return f"'{kind},' || " + " || ',' || ".join(texts)


@query("p24_config_sentences", "configs", " UNION ALL ".join(
    f"SELECT config_id, '$' || body || '*' || {{XOR:body}} AS sentence FROM (SELECT config_id, {_config_line(k)} AS body FROM configs)"
    for k in ("PNORI", "PNORI1", "PNORI2")))
def _(f):
    out = None
    for kind in ("PNORI", "PNORI1", "PNORI2"):
        part = f.configs.select("config_id", S.config_sentence(kind).alias("sentence"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p25_message_type", "raw", """SELECT substring(raw_sentence, 2, position(',' IN raw_sentence) - 2) AS message_type,
 count(*) AS count FROM raw WHERE checksum_valid GROUP BY 1""")
def _(f):
    from brinelake.operators.aggregates import counts

    return counts(f.raw.where("checksum_valid"), S.message_type("raw_sentence").alias("message_type"))


# --------------------------------------------------------------------------- T1-T21
def _layout_query(number: int, layout: L.Layout) -> None:
    name = f"t{number:02d}_{layout.prefix.lower()}"

    @query(name)
    def _(f, layout=layout):
        parsed = P.parse_lines(f.sql(SL.lines_sql(layout)).drop("received_at"))
        keep = parsed.withColumns({"line_id": F.col("line_no"), "stream_id": F.col("checksum_valid")})
        typed = P.typed_table(keep, layout.table)
        columns = [F.col("line_id").alias("line_no"), F.col("stream_id").alias("checksum_valid")]
        for spec in layout.fields:
            kind = {L.INT: "bigint", L.NUM: "double", L.OPT: "double"}.get(spec.kind)
            columns.append(F.col(spec.name).cast(kind).alias(spec.name) if kind else F.col(spec.name))
        if layout.payload:
            columns += [F.size(layout.payload).cast("bigint").alias("payload_size"),
                        F.aggregate(layout.payload, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("payload_sum")]
        if layout.dated:
            columns.append(F.col("measured_at"))
        return typed.select(*columns)

    ORACLES[name] = duck("", SL.expected_sql(layout))


for _i, _l in enumerate(L.layouts(), 1):
    _layout_query(_i, _l)


@query("v01_custom_layout", "sensor", """SELECT record_id AS line_no, heading AS depth, head_id AS note FROM sensor WHERE heading <= 250.0""")
def _(f):
    custom = L.Layout("PDEPTH", "depths", L.POSITIONAL, (
        L.FieldSpec("depth", L.NUM, "decimal(6,2)", lo=0.0, hi=250.0), L.FieldSpec("note", L.TEXT, "string")))
    L.register_layout(custom)
    try:
        lines = f.sensor.select(F.col("record_id").alias("line_no"), F.concat_ws(
            ",", F.lit("$PDEPTH"), F.col("heading").cast("string"), F.col("head_id")).alias("raw_sentence"))
        typed = P.typed_table(P.parse_lines(lines).withColumn("line_id", F.col("line_no")), "depths")
        return typed.select(F.col("line_id").alias("line_no"), F.col("depth").cast("double").alias("depth"), "note")
    finally:
        L.unregister_layout("PDEPTH")
