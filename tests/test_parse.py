"""Classification and the 21 layouts."""

import random

import pytest
from pyspark.sql import functions as F

from brinelake import layouts as L
from brinelake.functions.patterns import digits, line_pattern
from brinelake.plans import parse as P

GOOD = {
    "PNORI": "$PNORI,4,Delta250700042,4,36,0.35,0.50,0", "PNORI1": "$PNORI1,4,700042,4,36,0.35,0.50,XYZ",
    "PNORI2": "$PNORI2,IT=4,SN=700042,NB=4,NC=36,BD=0.35,CS=0.50,CY=XYZ",
    "PNORS": "$PNORS,061722,143027,00000000,00C10020,12.6,1487.5,131.4,-3.1,4.8,1.250,17.31,0,0",
    "PNORS1": "$PNORS1,042519,071850,0,11000041,18.7,1502.5,0.02,211.6,12.2,0.02,-7.9,0.02,87.125,0.02,9.43",
    "PNORS2": "$PNORS2,DATE=042519,TIME=071850,EC=0,SC=11000041,BV=18.7,SS=1502.5,HSD=0.02,H=211.6,PI=12.2,PISD=0.02,R=-7.9,RSD=0.02,P=87.125,PSD=0.02,T=9.43",
    "PNORS3": "$PNORS3,BV=18.7,SS=1475.3,H=64.8,PI=6.5,R=1.9,P=31.204,T=10.52",
    "PNORS4": "$PNORS4,18.7,1475.3,64.9,6.4,1.8,31.193,10.51",
    "PNORC": "$PNORC,061722,143027,4,0.31,0.42,-0.05,-0.06,0.52,36.4,C,71,69,74,70,33,38,35,31",
    "PNORC1": "$PNORC1,042519,071850,3,11.0,0.215,0.215,-0.215,-0.215,64.5,64.5,64.5,64.5,91,91,91,91",
    "PNORC2": "$PNORC2,DATE=042519,TIME=071850,CN=3,CP=11.0,VE=0.215,VN=0.215,VU=-0.215,VU2=-0.215,A1=64.5,A2=64.5,A3=64.5,A4=64.5,C1=91,C2=91,C3=91,C4=91",
    "PNORC3": "$PNORC3,CP=4.5,SP=0.874,DIR=203.5,AA=9,AC=47", "PNORC4": "$PNORC4,12.5,0.633,87.2,47,9",
    "PNORH3": "$PNORH3,DATE=230415,TIME=110530,EC=0,SC=1B070000", "PNORH4": "$PNORH4,230415,113030,0,1B070000",
    "PNORA": "$PNORA,210614,041502,0.000,31.118,20417,01,1.7,-3.4",
    "PNORW": "$PNORW,050318,201500,0,1,1.42,-9.00,1.88,2.31,4.62,5.10,-9.00,77.50,31.20,80.10,1.75,2.00,2048,1,0.41,302.75,0C01",
    "PNORB": "$PNORB,050318,201500,1,4,0.02,0.20,0.38,6.25,11.10,71.00,28.40,70.30,0000",
    "PNORE": "$PNORE,050318,201500,1,0.02,0.01,3,0.000,-9.00,1.5", "PNORF": "$PNORF,A1,050318,201500,1,0.02,0.01,2,0.0517,-9.0000",
    "PNORWD": "$PNORWD,MD,050318,201500,1,0.02,0.01,3,12.5,348.2,x",
}
BAD = [
    "garbage", "$nocomma", "$PXXXX,1,2", "$pnors,1", "$PNORS,1,2", "$PNORI,4,S,3,20,0.20,1.00,0", "$PNORI,1,S,3,20,0.20,1.00,0",
    "$PNORI,0,S,3,20,0.00,1.00,0", "$PNORI,4,S,4,200,0.20,1.00,0", "$PNORI1,4,AB,4,30,1.00,5.00,BEAM",
    "$PNORI2,IT=4,SN=1,NB=4,NC=30,BD=1.00,CS=5.00,CY=BEAM,CY=ENU", "$PNORS3,BV=18.7,BV=x,SS=1475.3,H=64.8,PI=6.5,R=1.9,P=31.204,T=10.52",
    "$PNORS3,BV=1,BV=18.7,SS=1475.3,H=360.0,PI=6.5,R=1.9,P=31.204,T=10.52", "$PNORS4,18.7,1475.3,64.9,6.4,1.8,15000.0,10.51",
    "$PNORC2,DATE=042519", "$PNORC3,CP=4.5,SP=0.874,DIR=203.5,AA=9", "$PNORC3,CP=4.5,SP=0.874,DIR=203.5,AA=9,AC=47,XX=1",
    "$PNORC3,sp=0.874,CP=4.5, DIR = 203.5 ,aa=6,AC=47", "$PNORA,DATE=210614,TIME=041502,P=0.000,A=31.118,Q=20417,ST=01,PI=1.7,R= -3.4,Z=1,junk",
    "$PNORA,date=210614,TIME=041502,P=0.000,A=31.118,Q=20417,ST=01,PI=1.7,R=-3.4", "$PNORE,050318,201500,1,0.02,0.01,9,1,2",
    "$PNORE,050318,201500,1,0.02,0.01,0,1,2", "$PNORE,050318,201500,2,0.02,0.01,2,1,2", "$PNORE,050318,201500,1,0.02,0.01,2,1,2,3,4",
    "$PNORE,050318,201500,1,0.02,0.01,x,1,2", "$PNORB,050318,201500,2,4,0.02,0.20,0.38,6.25,11.10,71.00,28.40,70.30,0000",
    "$PNORB,050318,201500,1,4,0.02,9.995,0.38,6.25,11.10,71.00,28.40,70.30,0000", "$PNORB,050318,201500,1,4,0.02,9.994,0.38,6.25,11.10,71.00,28.40,360.0,0000",
    "$PNORS,131722,143027,0,00C10020,12.6,1487.5,131.4,-3.1,4.8,1.250,17.31,0,0", "$PNORS,061722,143027,0,00C10020,12.6,1487.5,-9.0,-3.1,4.8,1.250,17.31,0,0",
    "$PNORS,061722,143027,0,00C10020,nan,1487.5,1.0,-3.1,4.8,1.250,17.31,0,0", "$PNORS,061722,143027,0,00C10020,1_4.4,1487.5,1.0,-3.1,4.8,1.250,17.31,0,40000",
    " $PNORS , 061722,143027,0,00C10020,12.6,1487.5,131.4,-3.1,4.8,1.250,17.31,0,0 *00 ", "$PNORH4,991332,113030,0,1B070000", "   ", "", "\x00\x01\x02ab",
    "café and more text here", "$PNORC4,12.5,0.633,87.2,47,9*6E", "$PNORC4,12.5,0.633,87.2,47,9*",
    "$PNORS1,042519,071850,0,11000041,18.7,1502.5,nan,211.6,12.2,0.02,-7.9,0.02,87.125,0.02,9.43",
]
SHOWN = ["i", "raw_sentence", "record_type", "parse_status", "error_type", "error_message", "checksum", "checksum_expected", "checksum_valid", "payload"]


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "i int, raw_sentence string").repartition(2)


def status(spark, lines, **options):
    rows = P.parse_lines(frame(spark, lines), **options).collect()
    return {r.i: r for r in rows}


def test_every_layout_has_an_accepted_example(spark):
    got = status(spark, list(GOOD.values()))
    assert [got[i].parse_status for i in range(len(GOOD))] == ["OK"] * 21, [(k, got[i].error_message) for i, k in enumerate(GOOD)]
    assert [got[i].record_type for i in range(len(GOOD))] == list(GOOD)
    assert got[18].payload == [0.0, None, 1.5] and got[20].payload == [12.5, 348.2, None]


def test_rejections(spark):
    got = status(spark, BAD)
    types = {BAD[i]: (r.parse_status, r.error_type) for i, r in got.items()}
    fail, broken = ("FAIL", "PARSE_ERROR"), ("FAIL", "CONSTRAINT_VIOLATION")
    assert types["$PXXXX,1,2"] == ("PENDING", None) and types["garbage"] == fail and types["$pnors,1"] == fail
    assert types["$PNORI,4,S,4,200,0.20,1.00,0"] == broken and types[BAD[6]] == fail and types[BAD[7]] == fail
    assert types[BAD[10]] == fail and types[BAD[11]] == fail and types[BAD[12]] == ("OK", None)
    assert types[BAD[13]] == broken and types[BAD[17]] == ("OK", None) and types[BAD[18]] == ("OK", None)
    assert types[BAD[19]] == fail and types[BAD[23]] == ("OK", None) and types[BAD[25]] == broken and types[BAD[26]] == broken
    assert types[BAD[27]] == broken and types["\x00\x01\x02ab"] == ("FAIL", "BINARY_DATA")
    assert types["café and more text here"] == ("FAIL", "DECODE_ERROR")
    assert types[BAD[31]] == broken  # readable, but 40000 is no SMALLINT
    assert "" not in types and "   " not in types
    assert got[BAD.index("garbage")].record_type == "UNKNOWN"


def mutated(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        line = list(rng.choice(list(GOOD.values())))
        for _ in range(rng.randint(0, 2)):
            k, c = rng.randrange(len(line)), rng.choice("0123456789.,-=*$ ABEXx_")
            kind = rng.random()
            if kind < 0.5:
                line[k] = c
            elif kind < 0.75:
                line.insert(k, c)
            elif len(line) > 1:
                del line[k]
        out.append("".join(line) + rng.choice(["", "*00", "*5B "]))
    return out


@pytest.mark.parametrize("mode", ["exact", "le_minus_9"])
def test_pattern_and_field_rules_agree(spark, mode):
    """The pattern only saves work: with and without it every line ends the same."""
    lines = list(GOOD.values()) + BAD + mutated(7, 1500)
    a, b = (P.parse_lines(frame(spark, lines), sentinel_mode=mode, plain_first=p) for p in (True, False))
    left = {r.i: r for r in a.select(*SHOWN, "vals").collect()}
    right = {r.i: r for r in b.select(*SHOWN, "vals").collect()}
    assert left.keys() == right.keys()
    for i, r in left.items():
        assert r.parse_status == right[i].parse_status, (lines[i], r.error_message, right[i].error_message)
        if r.parse_status == "OK":
            assert r == right[i], lines[i]
    for table in L.tables():
        x, y = (P.typed_table(p, table).orderBy("original_sentence").collect() for p in (a, b))
        assert sorted(map(str, x)) == sorted(map(str, y)), table


def test_strict_mode_reports_both_checksums(spark):
    rows = P.parse_errors(P.parse_lines(frame(spark, ["$PNORC4,12.5,0.633,87.2,47,9*6E", "$PNORC4,12.5,0.633,87.2,47,9*41",
                                                      "$PNORC4,12.5,0.633,87.2,47,9"]), strict=True)).collect()
    assert [(r.error_type, r.checksum_actual, r.checksum_expected) for r in rows] == [("CHECKSUM_FAILED", "6E", "41")]


def test_round_trip_of_configurations(spark):
    from brinelake.functions.sentences import config_sentence

    for kind in ("PNORI", "PNORI1", "PNORI2"):
        table = "pnori" if kind == "PNORI" else "pnori12"
        typed = P.typed_table(P.parse_lines(frame(spark, [GOOD[kind]])), table)
        again = typed.select(config_sentence(kind, False).alias("s")).first().s
        assert again == GOOD[kind]


def test_registered_layout_is_parsed(spark):
    extra = L.Layout("PTEST", "ptest", L.POSITIONAL, (L.FieldSpec("depth", L.NUM, "decimal(5,2)", lo=0.0, hi=50.0),
                                                     L.FieldSpec("note", L.TEXT, "string")))
    L.register_layout(extra)
    try:
        parsed = P.parse_lines(frame(spark, ["$PTEST,12.5,ok", "$PTEST,99,ok"]))
        rows = P.typed_table(parsed, "ptest").collect()
        assert [(float(r.depth), r.note) for r in rows] == [(12.5, "ok")]
        assert {r.parse_status for r in parsed.collect()} == {"OK", "FAIL"}
    finally:
        L.unregister_layout("PTEST")


def test_typed_columns(spark):
    parsed = P.parse_lines(frame(spark, list(GOOD.values())))
    r = P.typed_table(parsed, "pnorc12").where("sentence_type = 'PNORC2'").first()
    assert (str(r.vel3), r.data_format, r.measurement_id, str(r.measured_at)) == ("-0.2150", 102, 42519071850, "2019-04-25 07:18:50")
    w = P.typed_table(parsed, "pnorw_data").first()
    assert w.h3 is None and str(w.hm0) == "1.42" and w.wave_error_code == "0C01"
    c = P.typed_table(parsed, "pnorc34").where("sentence_type = 'PNORC4'").first()
    assert (c.avg_correlation, c.avg_amplitude) == (47, 9)
    assert P.typed_table(parsed, "pnori").first().coord_system_name == "ENU"


def test_digit_ranges():
    import re

    rng = random.Random(1)
    for _ in range(60):
        low = rng.choice([0, 1, rng.randrange(0, 3000)])
        high = low + rng.choice([0, 5, rng.randrange(0, 4000)])
        p = re.compile(digits(low, high))
        assert [x for x in range(0, 8000) if p.fullmatch(str(x))] == list(range(low, high + 1))
    assert all(re.match(line_pattern(layout), GOOD[layout.prefix]) for layout in L.layouts() if layout.prefix != "PNORWD")


def test_filters_do_not_repeat_the_parse(spark):
    """A filter on the status reads the result of the one evaluation below it."""
    plan = P.typed_table(P.parse_lines(frame(spark, list(GOOD.values()))), "pnors12")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1523") == 0 and plan.count("Generate inline") == 2


def test_counts_of_outputs(spark):
    parsed = P.parse_lines(frame(spark, BAD))
    n = parsed.count()
    decode = parsed.where("error_type = 'DECODE_ERROR'").count()
    assert P.raw_lines(parsed).count() == n - decode
    assert P.parse_errors(parsed).count() == parsed.where(F.col("parse_status") == "FAIL").count()
