"""Lines of a session with tiny splits: few tasks, the same numbers."""

from pyspark.sql import functions as F

from brinelake.sources.lines import number_lines, read_lines


def test_many_small_splits_share_tasks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.nmea").write_text("".join(f"{name},{i}\n" for i in range(30_000)))
    key = "spark.sql.files.maxPartitionBytes"
    old, got = spark.conf.get(key), {}
    try:
        for size in ("128m", "2k", "2048"):
            spark.conf.set(key, size)
            lines = read_lines(spark, str(tmp_path), F.lit("s"))
            tasks = lines.rdd.getNumPartitions()
            rows = number_lines(lines).select("raw_sentence", "line_no", "line_id", "block_start").collect()
            got[size] = tasks, sorted(r[:3] for r in rows), len({r.block_start for r in rows})
    finally:
        spark.conf.set(key, old)
    assert got["2k"][0] <= 2 and got["2k"][2] > 100  # splits as asked for, two tasks at most
    assert got["128m"][1] == got["2k"][1] == got["2048"][1] and len(got["2k"][1]) == 60_000
    assert all(int(r[0][2:]) + 1 == r[1] for r in got["2k"][1])
