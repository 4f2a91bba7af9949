"""Filters, unions, spectra, profiles, metadata and upgrade jobs on small frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brinelake.functions import arrays as A
from brinelake.operators import aggregates as G
from brinelake.operators import filters as K
from brinelake.operators import joins as J
from brinelake.operators import metadata as C
from brinelake.operators import profiles, spectra
from brinelake.operators import unions as U
from brinelake.plans import upgrade as M

T0 = datetime(2026, 1, 16, 1, 0)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(i, T0 + timedelta(hours=i) if i % 10 else None, float(i % 7), f"Text {i}") for i in range(500)]
    return spark.createDataFrame(rows, "record_id int, received_at timestamp_ntz, y double, s string").repartition(3)


@pytest.mark.parametrize("limit", [1, 37, 449, 450, 460, 600, None])
@pytest.mark.parametrize("descending", [True, False])
def test_first_rows(series, limit, descending):
    got = [r.record_id for r in K.first_rows(series, "received_at", "record_id", limit, descending).collect()]
    timed, rest = [i for i in range(500) if i % 10], [i for i in range(500) if i % 10 == 0]
    want = sorted(timed, reverse=descending) + sorted(rest, reverse=descending)
    assert got == want[:limit]


def test_no_limit_unless_asked(spark, series):
    assert K.query_data(series).count() == K.query(series).count() == K.time_series(series, ["y"], "all").count() == 500


def test_filters(series):
    assert K.equals(series, {"s": None}).count() == 0
    assert K.project(series, ["zz"]).columns == series.columns
    assert K.contains_text(series, {"s": "TEXT 49"}).count() == 11
    assert K.look_back(series, "nonsense").count() == 500
    assert K.look_back(series, "24h", T0 + timedelta(hours=100)).count() > 300
    found = K.query_data(series, search={"s": "text 1"}, limit=5)
    assert found.count() == 5
    with pytest.raises(ValueError):
        K.query(series, order_by="nope")
    got = K.validity_report(series.select(F.lit(360.0).alias("heading"), F.lit(4).alias("instrument_type_code"),
                                          F.lit(3).alias("beam_count"))).first()
    assert got.validation_errors == ["heading out of range", "beam_count does not suit the instrument"] and not got.is_fully_valid


def test_column_stats(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "temperature double")
    r = G.column_stats(df, ["temperature"]).first()
    assert (r.min_val, r.max_val, r.avg_val, r["count"]) == (1.0, 10.0, 5.5, 10)


def test_seven_minute_bucket_origin(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 16, 1, 3, 36), 1.0)], "received_at timestamp_ntz, v double")
    assert G.time_buckets(df, "v", 7).first().bucket == datetime(2026, 1, 16, 0, 57)


def test_profile_depths(spark):
    df = spark.createDataFrame([(T0, 1, None, 0.1), (T0, 2, 9.0, 0.2), (T0 - timedelta(days=400), 1, None, 0.3)],
                               "measured_at timestamp_ntz, cell_index int, cell_distance double, vel1 double")
    got = [(r.depth, r.vel1) for r in profiles.velocity_profiles(df, cell_size=2.0, blanking=0.5).collect()]
    assert got == [(2.5, 0.1), (9.0, 0.2)]
    both = profiles.velocity_profiles(df, timestamps=[T0, T0 - timedelta(days=400)])
    assert both.count() == 3


def energy_frame(spark, rows):
    return spark.createDataFrame(rows, "record_id int, received_at timestamp_ntz, measurement_date string, measurement_time string, "
                                 "start_frequency double, step_frequency double, num_frequencies int, energy_densities array<double>")


def test_directional_spectrum(spark):
    e = energy_frame(spark, [(1, T0, "011626", "010000", 0.1, 0.05, 3, [1.0, None, 3.0]),
                             (2, T0 + timedelta(hours=1), "011626", "020000", 0.1, 0.05, 2, [2.0, 2.0])])
    d = spark.createDataFrame([(1, "011626", "010000", "MD", [180.0, 190.0, 200.0]), (2, "011626", "010000", "DS", [10.0, None, 15.0]),
                               (3, "011626", "010000", "MD", [0.0, 0.0, 0.0]), (4, "011626", "020000", "MD", [5.0, 6.0])],
                              "record_id int, measurement_date string, measurement_time string, direction_type string, values array<double>")
    one = spectra.directional_spectrum(e, d).first()
    assert one.frequencies == [0.1, 0.15, 0.2] and one.directions == [180.0, 190.0, 200.0] and one.spreads == [10.0, None, 15.0]
    later = spectra.directional_spectrum(e, d, T0 + timedelta(hours=1)).first()
    assert later.spreads == [0.0, 0.0] and later.directions == [5.0, 6.0]
    by_text = spectra.directional_spectrum(e.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 3 DAYS")), d, T0).first()
    assert by_text.energy == [1.0, None, 3.0]
    assert spectra.directional_spectrum(e, d, T0 + timedelta(days=9)).count() == 0
    all_ = spectra.directional_spectra(e, d)
    peak = {r.measurement_time: (r.peak_frequency, r.peak_energy, r.peak_direction) for r in spectra.peaks(all_).collect()}
    assert peak == {"010000": (0.2, 3.0, 200.0), "020000": (0.1, 2.0, 5.0)}
    grid = spectra.spreading_grid(all_).groupBy("measurement_time", "bin").agg(F.sum("intensity").alias("s"), F.count("*").alias("n"))
    for r in grid.collect():
        want = {"010000": [1.0, 0.0, 3.0], "020000": [2.0, 2.0]}[r.measurement_time][r.bin]
        assert r.n == 72 and abs(r.s * 5 - want) < 1e-9
    assert [r.size for r in spectra.bubbles(all_).where("energy IS NULL").collect()] == [5.0]


def test_heatmap_padding(spark):
    e = energy_frame(spark, [(1, T0, "a", "b", 0.1, 0.1, 3, [1.0, 2.0, 3.0]), (2, T0 + timedelta(1), "a", "c", 0.1, 0.1, 1, [4.0]),
                             (3, T0 + timedelta(2), "a", "d", 0.1, 0.1, 0, [])])
    assert [r.energies for r in spectra.energy_heatmap(e).orderBy("record_id").collect()] == [[1.0, 2.0, 3.0], [4.0, 0.0, 0.0]]


def test_arrays(spark):
    r = spark.range(1).select(
        A.decode_array(F.lit("[1.5,null,2]")).alias("a"), A.encode_array(F.array(F.lit(1.5), F.lit(None))).alias("t"),
        A.frequency_axis(F.lit(0.1), F.lit(0.05), F.lit(0)).alias("none"), A.mean_step(F.array(F.lit(0.5))).alias("one"),
        A.direction(F.lit(-1.0), F.lit(0.0)).alias("d"), A.direction(F.lit(-1.0), F.lit(0.0), True).alias("c")).first()
    assert (r.a, r.t, r.none, r.one, r.d, r.c) == ([1.5, None, 2.0], "[1.5,null]", [], 0.01, -90.0, 270.0)


def test_join_keys(spark):
    a = spark.createDataFrame([(1, "d", "t", 101)], "measurement_id long, measurement_date string, measurement_time string, data_format int")
    assert J.burst_key(a, a) == ["measurement_id", "data_format"]
    assert J.burst_key(a, a.drop("measurement_id", "data_format")) == ["measurement_date", "measurement_time"]


def test_union_widening(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "t")], "x double, z string")
    out = U.union_widening([a, b])
    assert dict(out.dtypes) == {"x": "double", "y": "int", "z": "string"} and out.count() == 2


def test_metadata(spark, series):
    assert C.resolve("pnorw_data", {"pq_pnorw"}) == "pq_pnorw" and C.resolve("pnors_df100", {"pq_pnors"}) == "pq_pnors"
    assert C.resolve("pnorc12", {"pq_pnorc12", "pq_pnorc"}) == "pq_pnorc12" and C.resolve("pnorc12", {"pq_pnorc"}) == "pq_pnorc"
    assert C.resolve("wave_measurement_full", {"pq_pnorw"}) is None
    assert C.display_name("pnors_df100") == "Pnors Df100" and C.display_name("my_log") == "MY Log"
    rows = {r.column_name: (r.column_type, r.unit) for r in C.describe(spark, "s", series.withColumn("temperature", F.lit(1.0))).collect()}
    assert rows["received_at"] == ("TIMESTAMP", None) and rows["temperature"] == ("NUMERIC", "°C") and rows["s"] == ("TEXT", None)
    assert C.time_column(series) == "received_at"
    C.register_sql_functions(spark)
    r = spark.sql("SELECT nmea_checksum('$PNORH3,DATE=141112,TIME=081946,EC=0,SC=2A4C0000*5F') AS c, nmea_type('$A1,b') AS t").first()
    assert (r.c, r.t) == ("5F", "A1")
    with pytest.raises(Exception):
        C.run_sql(spark, "SELECT nothing FROM nowhere")


def test_upgrade_skips_what_is_missing(spark):
    new = spark.createDataFrame([(1, "x")], "record_id int, main_dir string")
    assert M.waves(new) is new
    assert M.consolidate("pnorc34", {}) is None
    out = M.upgrade({"raw_lines": new})
    assert set(out) == {"raw_lines"}


def test_instruments_of_one_second_stay_apart(spark):
    """Typed tables of two streams that sampled at the same second, straight from parsed lines."""
    from brinelake.operators import joins
    from brinelake.plans import parse

    rows = []
    for k, stream in enumerate(("north", "south")):
        rows.append((f"{stream}-1", stream, f"$PNORS,061722,143027,00000000,00C10020,12.6,1487.5,{131 + k}.4,-3.1,4.8,1.250,17.31,0,0"))
        for cell in (1, 2):
            rows.append((f"{stream}-c{cell}", stream, f"$PNORC,061722,143027,{cell},0.3{k},0.42,-0.05,-0.06,0.52,36.4,C,71,69,74,70,33,38,35,31"))
    lines = spark.createDataFrame(rows, "line_id string, stream_id string, raw_sentence string").withColumn(
        "received_at", F.lit("2022-06-17 14:30:28").cast("timestamp_ntz"))
    parsed = parse.parse_lines(lines)
    sensors, cells = parse.typed_table(parsed, "pnors_df100"), parse.typed_table(parsed, "pnorc_df100")
    got = joins.current_profile_df100(sensors, cells).collect()
    assert sorted((r.stream_id, r.cell_index, float(r.heading), round(float(r.vel1), 2)) for r in got) == [
        ("north", 1, 131.4, 0.30), ("north", 2, 131.4, 0.30), ("south", 1, 132.4, 0.31), ("south", 2, 132.4, 0.31)]
    assert K.query_data(sensors).count() == 2
