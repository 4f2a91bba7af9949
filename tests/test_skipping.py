"""The per-file index never changes an answer."""

from datetime import datetime

from brinelake.session import fresh_folder
from brinelake.sources import lake, skipping


def test_index(spark):
    base = fresh_folder(spark, "skip")

    def rows(ids):
        return spark.createDataFrame([(i, datetime(2026, 1, 1 + i % 5, i % 24, i % 60), f"head{i % 3}", "PENDING") for i in ids],
                                     "line_id bigint, received_at timestamp_ntz, head_id string, parse_status string")

    def ids(**asked):
        return sorted(r.line_id for r in skipping.read_matching(spark, base, "RAW_LINES", **asked).collect())

    lake.write_run(rows(range(3000)), base, "RAW_LINES", "0")
    assert ids(equal={"line_id": 77}) == [77]  # no index yet: every file is opened
    skipping.index_files(spark, base, "RAW_LINES", ["received_at"], ["line_id", "head_id"])
    for i in (0, 1, 77, 1234, 2999):
        assert ids(equal={"line_id": i}) == [i]
    assert ids(equal={"line_id": 5000}) == [] and ids(equal={"head_id": "head1", "line_id": 4}) == [4]
    hour = (datetime(2026, 1, 2, 6), datetime(2026, 1, 2, 6, 59))
    want = [i for i in range(3000) if i % 5 == 1 and i % 24 == 6]
    assert ids(between={"received_at": hour}) == want
    every = len(skipping.read_matching(spark, base, "RAW_LINES").inputFiles())
    assert len(skipping.read_matching(spark, base, "RAW_LINES", equal={"line_id": 77}).inputFiles()) < every
    lake.write_run(rows(range(5000, 5010)), base, "RAW_LINES", "1")  # newer than the index
    assert ids(equal={"line_id": 5005}) == [5005]
    up = spark.createDataFrame([(77, "OK", 1)], "line_id bigint, parse_status string, update_no int")
    lake.write_status_updates(spark, base, "RAW_LINES", up)
    got = skipping.read_matching(spark, base, "RAW_LINES", equal={"line_id": 77}).first()
    assert got.parse_status == "OK"
    days = [datetime(2026, 1, d).date() for d in range(1, 6)]
    lake.compact(spark, base, "RAW_LINES", days)  # indexed files are gone, their entries do not matter
    assert ids(equal={"line_id": 77}) == [77] and len(ids()) == 3010
    skipping.index_files(spark, base, "RAW_LINES", ["received_at"], ["line_id", "head_id"])
    assert ids(equal={"line_id": 5005}) == [5005] and ids(between={"received_at": hour}) == want
