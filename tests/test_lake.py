"""Lake, line files, and the stream form of the ingest."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brinelake.plans import ingest as I
from brinelake.session import fresh_folder
from brinelake.sources import lake
from brinelake.sources.lines import number_lines, read_lines, stream_lines
from brinelake.streaming.live import LineIngest


def test_unfinished_files_are_skipped_and_reported(spark):
    base = fresh_folder(spark, "lake")
    df = spark.createDataFrame([(1, datetime(2026, 1, 16, 1)), (2, datetime(2026, 1, 17, 1))], "record_id int, received_at timestamp_ntz")
    lake.write_lake(df, base, "PNORS")
    lake.write_lake(df, base, "PNORS")
    day = f"{base}/PNORS/date=2026-01-16"
    for name in ("late.parquet.writing", "done.parquet.writing"):
        with open(f"{day}/{name}", "wb") as f:
            f.write(b"junk")
    twin = sorted(p for p in os.listdir(day) if p.endswith(".parquet"))[0]
    with open(f"{day}/{twin}.writing", "wb") as f:
        f.write(b"junk")
    rows = lake.read_type(spark, base, "PNORS", start=date(2026, 1, 16), end=date(2026, 1, 16))
    assert rows.count() == 2
    assert "PartitionFilters: [isnotnull(date" in rows._jdf.queryExecution().executedPlan().toString()
    now = datetime.now()
    for seconds, state in ((1, "waiting_first_retry"), (20, "waiting_second_retry"), (60, "fault_detected")):
        got = lake.stale_writes(spark, base, datetime.fromtimestamp(now.timestamp() + seconds)).collect()
        assert sorted(r.status for r in got) == sorted([state, state, "completed"])
    inventory = {(r.record_type, r.date): r.files for r in lake.lake_inventory(spark, base).collect()}
    assert inventory[("PNORS", date(2026, 1, 16))] == 2
    assert lake.register_lake_views(spark, base) == ["view_pnors"] and spark.table("view_pnors").count() == 4


def test_status_updates_latest_wins(spark):
    raw = spark.createDataFrame([(1, "PENDING", None), (2, "OK", "keep")], "line_id int, parse_status string, error_message string")
    up = spark.createDataFrame([(1, "FAIL", "a", 1), (1, "OK", None, 2)], "line_id int, parse_status string, error_message string, update_no int")
    assert sorted(tuple(r) for r in lake.apply_status_updates(raw, up).collect()) == [(1, "OK", None), (2, "OK", "keep")]


LINES = {
    "one": [b"\x01\x02\x03start of one", b"$PNORC3,CP=4.5,SP=1.0,DIR=203.5,AA=9,AC=47", b"$PNORH3,DATE=230415,TIME=110530,EC=0,SC=1B070000*5F",
            b"$PNORS3,BV=18.7,SS=1475.3,H=64.8,PI=6.5,R=1.9,P=31.204,T=10.52", b"$PNORC3,CP=4.5,SP=2.0,DIR=203.5,AA=9,AC=47",
            b"$PNORC3,CP=4.5,SP=3.0,DIR=203.5,AA=9,AC=47", b"", b"\x01\x02open", b"   ", b"\xff\xfestill open ................"],
    "two": [b"\x03\x04and on", b"$PNORC4,12.5,4.0,87.2,47,9*6E", b"garbage", b"$PXXXX,1,2", b"$PNORH4,230415,113030,0,1B070000",
            b"$PNORC4,12.5,5.0,87.2,47,9", b"\x01\x02last"],
}


def landed(folder, names):
    os.makedirs(folder, exist_ok=True)
    for i, name in enumerate(names):
        with open(f"{folder}/{name}.nmea", "wb") as f:
            f.write(b"\n".join(LINES[name]) + b"\n")
        os.utime(f"{folder}/{name}.nmea", (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture(scope="module")
def results(spark):
    source = fresh_folder(spark, "landing").replace("file:", "")
    landed(source, ["one", "two"])
    batch = fresh_folder(spark, "batch")
    I.ingest(number_lines(read_lines(spark, source)), batch, fresh_folder(spark, "staging"), assemble_blobs=True)
    live = fresh_folder(spark, "live")
    state = fresh_folder(spark, "state")
    LineIngest(live).start(stream_lines(spark, source, max_files=1), state, available_now=True).awaitTermination()
    LineIngest(live).start(stream_lines(spark, source, max_files=1), state, available_now=True).awaitTermination()
    return batch, live


def values(spark, base, folder, *columns):
    return sorted(tuple(map(str, r)) for r in spark.read.parquet(f"{base}/{folder}").select(*columns).collect())


def test_stream_equals_batch(spark, results):
    batch, live = results
    for folder, columns in (("RAW_LINES", ("raw_sentence", "parse_status", "record_type", "checksum_valid")),
                            ("PARSE_ERRORS", ("raw_sentence", "error_type")), ("PNORH", ("measurement_date", "measurement_time")),
                            ("PNORC34", ("speed", "measurement_date", "measurement_time", "cell_index"))):
        assert values(spark, batch, folder, *columns) == values(spark, live, folder, *columns), folder


def test_headers_and_blobs(spark, results):
    batch, live = results
    assert values(spark, batch, "PNORC34", "speed", "measurement_time", "cell_index") == [
        ("2.0000", "110530", "1"), ("3.0000", "110530", "2"), ("4.0000", "110530", "3"), ("5.0000", "113030", "1")]
    errors = values(spark, batch, "PARSE_ERRORS", "error_type", "raw_sentence")
    assert [e[0] for e in errors].count("BINARY_DATA") == 3  # the run over both files is one blob
    assert ("CONSTRAINT_VIOLATION", "$PNORC3,CP=4.5,SP=1.0,DIR=203.5,AA=9,AC=47") in errors
    parts = spark.read.parquet(f"{live}/BLOBS").groupBy("blob_id").agg(F.sum("line_count").alias("n"))
    assert sorted(r.n for r in parts.collect()) == [1, 1, 3]
    assert spark.read.parquet(f"{batch}/BLOBS").agg(F.sum("byte_count")).first()[0] == spark.read.parquet(
        f"{live}/BLOBS").agg(F.sum("byte_count")).first()[0]


def test_batch_can_run_again(spark, results):
    _, live = results
    before = values(spark, live, "RAW_LINES", "raw_sentence", "line_id")
    again = spark.read.parquet(f"{live}/_work/batch_id=1/lines").drop("line_in_block", "line_id")
    LineIngest(live).process(again, 1)
    assert values(spark, live, "RAW_LINES", "raw_sentence", "line_id") == before


def test_line_ids_repeat(spark, results):
    batch, live = results
    assert values(spark, batch, "PNORC34", "line_id") == values(spark, live, "PNORC34", "line_id")
