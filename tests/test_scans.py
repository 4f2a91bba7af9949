"""Two-level scans against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brinelake.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        stream = rng.choice(["a", "a", "a", "b", None])
        data.append((stream, i, rng.choice([None, None, None, i]), rng.randrange(5), rng.random() < 0.4))
    return spark.createDataFrame(data, "stream string, n long, v long, k int, bin boolean").repartition(5)


def whole_stream():
    return Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_carry_and_sum(rows, size):
    df = rows.withColumn("chunk", F.floor(F.col("n") / size))
    got = scans.carry_forward(df, {"last_v": F.col("v")}, ["stream"], ["chunk"], ["n"])
    want = df.withColumn("last_v", F.last("v", ignorenulls=True).over(whole_stream()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    got = scans.running_sum(df, {"total": F.col("k")}, ["stream"], ["chunk"], ["n"])
    want = df.withColumn("total", F.sum("k").over(whole_stream()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_one_stream_is_spread_over_chunks(rows):
    df = rows.withColumn("chunk", F.floor(F.col("n") / 100))
    plan = scans.carry_forward(df, {"x": F.col("v")}, ["stream"], ["chunk"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("size", [13, 5000])
def test_blob_parts_join_to_runs(rows, size):
    df = rows.where("stream IS NOT NULL").withColumns({
        "chunk": F.floor(F.col("n") / size), "data": F.concat(F.lit("\x01"), F.col("n").cast("string"))})
    parts = scans.blob_parts(df, "data", F.col("bin"), ["stream"], ["chunk"], ["n"], part_lines=3)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r.stream, r.run_no, r.chunk, r.part_no)):
        got[(r.stream, r.run_no)] = got.get((r.stream, r.run_no), b"") + bytes(r.payload)
    want, runs = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.n):
        if r.bin:
            key = (r.stream, runs.get(r.stream, 0))
            want[key] = want.get(key, b"") + r.data.encode()
        else:
            runs[r.stream] = runs.get(r.stream, 0) + 1
    assert got == want
    assert max(r.line_count for r in parts.collect()) <= 3


def test_top_n_limits_before_the_shuffle(rows):
    df = scans.first_per_group(rows.withColumn("received_at", F.col("n")), ["k"], 4, tie="n")
    assert df.groupBy("k").count().where("count <> 4").count() == 0
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-03 09:00:00", 2), ("b", "2024-01-01 00:00:00", 3)],
                                 "s string, t string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([("a", "2024-01-01 10:00:00", 5.0), ("a", "2024-01-01 11:00:00", 6.0), ("b", "2024-01-02 00:00:00", 7.0)],
                                  "s string, u string, x double").withColumn("u", F.col("u").cast("timestamp_ntz"))
    got = scans.as_of_join(left, right, ["s"], "t", "u", ["x"])
    assert sorted((r.i, r.x) for r in got.collect()) == [(1, 5.0), (2, 6.0), (3, None)]


def test_blob_parts_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from brinelake.operators import scans
    rows = [("s", k, "x" * (k % 7 + 1)) for k in range(100)] + [("s", 100, "y" * 50)]
    df = spark.createDataFrame(rows, "stream_id string, n long, raw string").withColumn("chunk", F.lit(0))
    parts = scans.blob_parts(df, "raw", F.lit(True), ["stream_id"], ["chunk"], ["n"], part_lines=9, part_bytes=20).orderBy("part_no").collect()
    assert b"".join(bytes(p.payload) for p in parts).decode() == "".join(r[2] for r in rows)
    assert all(p.line_count <= 9 and (p.byte_count <= 26 or p.line_count == 1) for p in parts) and len(parts) > 20
