"""Maintenance of the lake that survives crashes and replays."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brinelake.session import fresh_folder
from brinelake.sources import generations as G
from brinelake.sources import lake

KIND = "line_id int, received_at timestamp_ntz, parse_status string, error_message string, file_path string, line_no int"
DAYS = [date(2026, 1, 16), date(2026, 1, 17)]


def rows(spark, ids, status="PENDING"):
    return spark.createDataFrame([(i, datetime(2026, 1, 16 + i % 2, i % 24), status, None, "f", i) for i in ids], KIND)


def files(spark, folder):
    return {r.path for r in lake.list_files(spark, folder, "*.parquet").select("path").collect()}


def seen(spark, base):
    return sorted((r.line_id, r.parse_status, r.error_message) for r in lake.read_type(spark, base, "RAW_LINES").collect())


def updates(spark, ids, status, no=1, message=None):
    return spark.createDataFrame([(i, status, message, no) for i in ids],
                                 "line_id int, parse_status string, error_message string, update_no int")


@pytest.fixture
def base(spark):
    base = fresh_folder(spark, "safe")
    assert lake.write_run(rows(spark, range(10)), base, "RAW_LINES", "0")
    assert lake.write_run(rows(spark, range(10, 14)), base, "RAW_LINES", "1")
    return base


def test_replay_after_compaction_and_update(spark, base):
    want = seen(spark, base)
    assert len(want) == 14
    lake.compact(spark, base, "RAW_LINES", DAYS)
    assert not lake.write_run(rows(spark, range(10)), base, "RAW_LINES", "0")
    assert seen(spark, base) == want
    assert len(G.names(spark, f"{base}/RAW_LINES/date=*/batch_id=*")) == 2  # a part per day
    before = files(spark, base)
    assert lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [3, 5, 12], "OK", message="x"), run="u") == DAYS
    assert before <= files(spark, base)
    now = [(i, "OK", "x") if i in (3, 5, 12) else (i, s, m) for i, s, m in want]
    assert seen(spark, base) == now
    assert not lake.write_run(rows(spark, range(10, 14)), base, "RAW_LINES", "1")
    assert lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [3, 5, 12], "FAIL"), run="u") == []
    assert seen(spark, base) == now
    lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [3], "FAIL"))  # null keeps the message
    now[3] = (3, "FAIL", "x")
    assert seen(spark, base) == now
    lake.compact(spark, base, "RAW_LINES", DAYS[:1])
    assert seen(spark, base) == now
    lake.compact(spark, base, "RAW_LINES", DAYS)
    assert seen(spark, base) == now and not G.names(spark, f"{base}/RAW_LINES/_overlays/*")
    assert lake.write_run(rows(spark, [20]), base, "RAW_LINES", "2") and len(seen(spark, base)) == 15


def test_deaths(spark, base, monkeypatch):
    want = seen(spark, base)

    def dies(*args, **kw):
        raise KeyboardInterrupt

    for work in (lambda: lake.compact(spark, base, "RAW_LINES", DAYS),
                 lambda: lake.write_run(rows(spark, range(50, 60)), base, "RAW_LINES", "7"),
                 lambda: lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [1, 2], "OK"))):
        with monkeypatch.context() as m:
            m.setattr(G, "commit", dies)
            with pytest.raises(KeyboardInterrupt):
                work()
        assert seen(spark, base) == want
    assert {r.path for r in lake.lake_files(spark, base).collect()} < files(spark, base)
    assert lake.write_run(rows(spark, range(50, 60)), base, "RAW_LINES", "7")
    lake.compact(spark, base, "RAW_LINES", DAYS)
    assert len(seen(spark, base)) == 24
    assert {r.path for r in lake.lake_files(spark, base).collect()} == files(spark, base)  # remains are gone


def test_two_writers(spark, base, monkeypatch):
    own, between = G.commit, []

    def later(*args, **kw):
        if not between:
            between.append(1)
            work()
        return own(*args, **kw)

    monkeypatch.setattr(G, "commit", later)

    def work():
        lake.write_run(rows(spark, [30]), base, "RAW_LINES", "3")

    lake.compact(spark, base, "RAW_LINES", DAYS)
    assert len(seen(spark, base)) == 15
    between.clear()

    def work():
        lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [1], "OK"))

    with pytest.raises(G.Replaced):
        lake.compact(spark, base, "RAW_LINES", DAYS)
    assert seen(spark, base)[1] == (1, "OK", None)
    between.clear()

    def work():
        lake.compact(spark, base, "RAW_LINES", DAYS)

    with pytest.raises(G.Replaced):
        lake.write_status_updates(spark, base, "RAW_LINES", updates(spark, [2], "OK"))
    assert seen(spark, base)[2] == (2, "PENDING", None)


def test_updates_by_file_and_line(spark, base):
    up = spark.createDataFrame([("f", 4, "OK", 1), ("g", 5, "OK", 1)], "file_path string, line_no int, parse_status string, update_no int")
    lake.write_status_updates(spark, base, "RAW_LINES", up)
    assert [s for _, s, _ in seen(spark, base)].count("OK") == 1 and seen(spark, base)[4][1] == "OK"


def test_retention_to_the_row(spark, base):
    gone = lake.drop_expired(spark, base, "RAW_LINES", 1, datetime(2026, 1, 18, 5), rows="received_at")
    assert gone == ["date=2026-01-16"]
    assert [i for i, _, _ in seen(spark, base)] == [5, 7, 9, 11, 13]
    assert not lake.write_run(rows(spark, range(10)), base, "RAW_LINES", "0") and len(seen(spark, base)) == 5


def test_lakes_without_a_table(spark):
    base = fresh_folder(spark, "plain")
    lake.write_lake(rows(spark, range(6)), base, "RAW_LINES")
    assert G.current(spark, f"{base}/RAW_LINES") is None and len(seen(spark, base)) == 6
    lake.write_run(rows(spark, [7, 8]), base, "RAW_LINES", "a")
    lake.write_lake(rows(spark, [9]), base, "RAW_LINES")
    assert len(seen(spark, base)) == 9
    lake.compact(spark, base, "RAW_LINES", DAYS)
    assert len(seen(spark, base)) == 9 and not G.names(spark, f"{base}/RAW_LINES/date=*/*.parquet")
    lake.write_lake(rows(spark, [1]), base, "RAW_LINES", "overwrite")
    assert [r[0] for r in seen(spark, base)] == [1]


def test_batches_are_ranges():
    g = G.Generation()
    for run in ("3", "1", "x", "0", "2", "9"):
        g = g.with_run(run)
    assert g.batches == [[0, 3], [9, 9]] and g.runs == ["x"]
    assert g.has_run("2") and not g.has_run("4") and g.has_run("x") and not g.has_run("y")


def test_disagreeing_files(spark):
    base = fresh_folder(spark, "drift")
    day = f"{base}/PNORS/date=2026-01-16"
    for k, select in enumerate(("cast(id AS int) AS v, 'a' AS t", "id + 0.5D AS v", "id AS v, id AS t, true AS more", "cast(id AS int) AS v, 'b' AS t")):
        spark.range(k * 3, k * 3 + 3).selectExpr(*[c for c in select.split(", ")]).coalesce(1).write.mode("append").parquet(day)
    df = lake.read_type(spark, base, "PNORS")
    assert dict(df.dtypes) == {"v": "double", "t": "string", "more": "boolean", "date": "date"}
    got = sorted((r.v, r.t, r.more) for r in df.collect())
    assert got == [(0.0, "a", None), (1.0, "a", None), (2.0, "a", None), (3.5, None, None), (4.5, None, None), (5.5, None, None),
                   (6.0, "6", True), (7.0, "7", True), (8.0, "8", True), (9.0, "b", None), (10.0, "b", None), (11.0, "b", None)]
