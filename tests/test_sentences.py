"""Line-level functions against their plain definitions."""

import math

import pytest
from pyspark.sql import functions as F

from brinelake.functions import sentences as S

LINES = [
    "$PNORI,4,Signature1000900001,4,20,0.20,1.00,0*2E", "$A,b*00*7f", "no start,x", "$nocomma",
    "  $pnors , 1 ,2  * a1 ", "", "*", "$*", "$,", "$PNORE,1,2,,*ZZ", "$PNORC,\t1\t,2",
]


def xor_hex(line):
    text = line.removeprefix("$").split("*", 1)[0]
    value = 0
    for ch in text:
        value ^= ord(ch)
    return f"{value:02X}"


def test_checksum_prefix_and_fields(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "i int, s string")
    rows = df.select("s", S.checksum("s").alias("c"), S.checksum_valid("s").alias("v"), S.prefix("s").alias("p"),
                     S.split_fields("s").alias("f"), S.given_checksum("s").alias("g")).collect()
    for r in rows:
        assert r.c == xor_hex(r.s), r.s
        given = r.s.rsplit("*", 1)[1].strip().upper() if "*" in r.s else None
        assert r.g == given
        assert r.v == (None if given is None else xor_hex(r.s) == given)
        t = r.s.strip()
        assert r.p == (t[1:].split(",", 1)[0].upper() if t.startswith("$") and "," in t else None)
        assert r.f == [x.strip() for x in (t.rsplit("*", 1)[0] if "*" in t else t).split(",")]


@pytest.mark.parametrize("data", [
    b"", b"$PNORS,1,2", b"\x00" * 600, b"a" * 900 + b"\x01" * 100, b"a" * 950 + b"\xff" * 50, b"\tabc",
    b"a" * 1024 + b"\x00" * 500, b"a" * 921 + b"\x00" * 103, b"a" * 922 + b"\x00" * 102, b"abc\r"])
def test_binary_ratio(spark, data):
    head = data[:1024]
    odd = sum(not (0x20 <= b <= 0x7E or b in (10, 13)) for b in head)
    df = spark.createDataFrame([(bytearray(data),)], "b binary").select(F.decode("b", "ISO-8859-1").alias("t"))
    assert df.select(S.is_binary("t").alias("x")).first().x == (odd > len(head) // 10)


def test_numbers_read_as_python_reads_them(spark):
    texts = ["1", "-1", "+1.5", ".5", "5.", "1e3", "1E-2", "1_0", "1__0", "_1", "1.0f", "1.0d", "0x10", "", ".", "-",
             "nan", "inf", "-Infinity", "1,0", "--1", "1.2.3", "12a", "1 2", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", S.number("t").alias("n"), S.whole_number("t").alias("i")).collect():
        try:
            want = float(r.t) if r.t.isascii() else None
        except ValueError:
            want = None
        assert (r.n is None) == (want is None) and (want is None or r.n == want or math.isnan(want)), r.t
        try:
            whole = int(r.t) if r.t.isascii() else None
        except ValueError:
            whole = None
        assert r.i == whole, r.t


def test_date_and_time_digits(spark):
    from datetime import datetime

    digits = [f"{n:06d}" for n in range(0, 1_000_000, 97)] + ["022924", "022923", "240229", "230229", "022900", "12345", "1234567"]
    df = spark.createDataFrame([(d,) for d in digits], "d string")

    def fits(d, fmt):
        try:
            datetime.strptime(d, fmt)
            return len(d) == 6
        except ValueError:
            return False

    for r in df.select("d", *[F.col("d").rlike(p).alias(n) for n, p in (
            ("m", S.DATE_M_PATTERN), ("y", S.DATE_Y_PATTERN), ("t", S.TIME_PATTERN))]).collect():
        assert (r.m, r.y, r.t) == (fits(r.d, "%m%d%y"), fits(r.d, "%y%m%d"), fits(r.d, "%H%M%S")), r.d


def test_measured_at_both_conventions(spark):
    r = spark.range(1).select(
        S.measured_at(F.lit("011626"), F.lit("010336")).cast("string").alias("m"),
        S.measured_at(F.lit("260116"), F.lit("010336"), True).cast("string").alias("y"),
        S.measured_at(F.lit("991626"), F.lit("010336")).alias("bad"), S.measurement_id(
            F.lit("011626"), F.lit("010336")).alias("id"), S.measurement_id(F.lit("1"), F.lit("010336")).alias("short")).first()
    assert (r.m, r.y, r.bad, r.id, r.short) == ("2026-01-16 01:03:36", "2026-01-16 01:03:36", None, 11626010336, None)


def test_sentinels_exact_and_documented(spark):
    df = spark.createDataFrame([(t,) for t in ("-9.00", "-99.99", "-9.000", "-9.0000", "", "x", "-9.0", "-12", "3.5")], "t string")
    from brinelake.layouts import MISSING_MARKERS as M

    got = [tuple(r) for r in df.select(S.optional_number("t", M).alias("a"), S.optional_number("t", M, True).alias("b")).collect()]
    assert got == [(None, None)] * 6 + [(-9.0, None), (-12.0, None), (3.5, 3.5)]
