"""Large given tables are dealt to tasks of bounded size; the rows stay the same."""

from driver_queries import frames


def test_cells_in_bounded_tasks(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, id * 7 AS user_id
     FROM range(90) UNION ALL SELECT 5, timestamp_ntz'2024-01-02 00:00:00', 3 UNION ALL SELECT 6, NULL, 4
     UNION ALL SELECT NULL, NULL, NULL""").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("""SELECT IF(id % 50 = 0, NULL, id div 4) AS l_orderkey, CAST(id % 3 AS INT) AS l_linenumber, CAST(id % 11 AS DOUBLE) AS l_quantity,
     0.1D AS l_discount, 0.2D AS l_tax FROM range(2000)""").write.parquet(f"{tmp_path}/lineitem.parquet")

    def cells():
        return frames.Frames(spark, str(tmp_path)).cells

    monkeypatch.setattr(frames, "SPREAD_LEAST", 10**9)
    whole = cells()
    monkeypatch.setattr(frames, "SPREAD_LEAST", 8)
    monkeypatch.setattr(frames, "SPREAD_ROWS", 100)
    dealt = cells()
    assert "REPARTITION_BY_NUM" not in whole._jdf.queryExecution().toString()
    assert "hashpartitioning(seen_by" in dealt._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM, " in dealt._jdf.queryExecution().toString() and dealt.rdd.getNumPartitions() == 20
    assert whole.count() > 1000 and whole.exceptAll(dealt).isEmpty() and dealt.exceptAll(whole).isEmpty()


def test_sentences_from_rows_dealt_out(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, id * 7 AS user_id
     FROM range(900) UNION ALL SELECT 5, NULL, 3 UNION ALL SELECT NULL, NULL, NULL""").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = frames.Frames(spark, str(tmp_path)).lines
    monkeypatch.setattr(frames, "DEAL_ROWS", 100)
    dealt = frames.Frames(spark, str(tmp_path)).lines
    assert dealt.rdd.getNumPartitions() == 9 > whole.rdd.getNumPartitions()
    assert whole.count() == 902 and whole.exceptAll(dealt).isEmpty() and dealt.exceptAll(whole).isEmpty()


def test_cells_dealt_on_two_levels(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, id * 7 AS user_id
     FROM range(90) UNION ALL SELECT 5, NULL, 3 UNION ALL SELECT NULL, NULL, NULL""").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("""SELECT IF(id % 50 = 0, NULL, id div 4) AS l_orderkey, IF(id % 70 = 0, NULL, CAST(id % 3 AS INT)) AS l_linenumber,
     CAST(id % 11 AS DOUBLE) AS l_quantity, 0.1D AS l_discount, 0.2D AS l_tax FROM range(2000) UNION ALL SELECT 7, 1, 3D, 0.1D, 0.2D
     FROM range(100)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = frames.Frames(spark, str(tmp_path)).cells
    for name, value in (("SPREAD_LEAST", 8), ("SPREAD_ROWS", 100), ("STRIDE", 6)):
        monkeypatch.setattr(frames, name, value)
    dealt = frames.Frames(spark, str(tmp_path)).cells
    plan = dealt._jdf.queryExecution().toString()
    assert "hashpartitioning(seen_by" in plan and "hashpartitioning(l_orderkey" in plan and dealt.rdd.getNumPartitions() == 21
    assert whole.count() > 1000 and whole.exceptAll(dealt).isEmpty() and dealt.exceptAll(whole).isEmpty()
