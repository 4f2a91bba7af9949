"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the folder of the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local threads (default 8).  Every query runs whole into a sink that keeps nothing; the better
of two runs counts.  The frames that the queries read, and the line files for the parser and the
ingest, are written before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brinelake.plans.ingest import ingest  # noqa: E402
from brinelake.plans.parse import parse_lines  # noqa: E402
from brinelake.session import fresh_folder, local_session  # noqa: E402
from brinelake.sources import lake  # noqa: E402
from brinelake.sources.lines import number_lines, read_lines, stream_lines  # noqa: E402
from brinelake.streaming.live import LineIngest  # noqa: E402
from driver_queries import all_queries  # noqa: E402
from driver_queries.frames import Frames  # noqa: E402

HEADLINE = (
    "f12_validity", "k01_newest", "k03_time_series", "u02_all_sensors", "u05_bursts",
    "j01_wave_measurement", "j02_profile_df100", "j03_wave_full", "j03b_wave_bursts",
    "j04_profile_12", "j05_profile_34", "j08_complete_bursts", "g01_bucket_5m_avg",
    "g02_column_stats", "g05_hourly", "g07_per_cell", "g11_daily_log", "g14_amp_cells",
    "g14_amp_heatmap", "w01_header_carry", "w02_blob_index", "w04_layered", "d01_energy_long",
    "d06_configured_depth", "d09_directional", "d10_peaks", "d11_spreading", "x07_speed_direction",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(run, times: int = 2) -> float:
    seconds = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    known, frames = all_queries(), Frames(spark, folder)
    frames.keep(fresh_folder(spark, "bench-frames"), "sensor", "raw", "cells", "configs", "config_log", "spectra",
                "energy", "coefs", "dirs", "waves", "bands", "lines", "bursts34", "blob_lines")

    took = {name: best(lambda n=name: consume(known[n](spark, folder))) for name in HEADLINE}

    lines_path = fresh_folder(spark, "bench-lines")
    frames.lines.repartition(int(cpus)).select("raw_sentence").write.text(lines_path)
    lines = read_lines(spark, lines_path, pattern="*.txt")
    count = lines.count()
    parsed = parse_lines(lines)
    took["p19_parse_files"] = best(lambda: consume(parsed), 3)
    took["a03_ingest"] = best(lambda: ingest(number_lines(read_lines(spark, lines_path, pattern="*.txt")),
                                             fresh_folder(spark, "bench-ingest"), fresh_folder(spark, "bench-staging")))

    def live() -> None:
        rows = stream_lines(spark, lines_path, pattern="*.txt")
        LineIngest(fresh_folder(spark, "bench-live")).start(
            rows, fresh_folder(spark, "bench-state"), available_now=True).awaitTermination()

    took["r01_stream_ingest"] = best(live)
    base = fresh_folder(spark, "bench-lake")
    took["a04_write_lake"] = best(lambda: lake.write_lake(frames.sensor, base, "PNORS", "overwrite"))

    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": folder.rsplit("/sf", 1)[-1],
        "ingested_lines_per_sec": round(count / took["a03_ingest"]),
        "streamed_lines_per_sec": round(count / took["r01_stream_ingest"]), "parsed_lines": count, "parsed_lines_per_sec": round(count / took["p19_parse_files"])}))
    spark.stop()


if __name__ == "__main__":
    main()
