"""Queries over the given tables against DuckDB, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")

from driver_queries import all_oracles, all_queries  # noqa: E402

# Slow ones; tests/test_parse.py and tests/test_lake.py cover the same ground on small frames.
SLOW = ("r01", "r04", "r05", "a03", "s01", "t0", "t10", "t12", "t13", "t14", "t15", "t18", "t20", "t21")
NAMES = [n for n in all_queries() if not n.startswith(SLOW)]


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    import compare

    result = compare.compare(spark, compare.database(FOLDER), FOLDER, name)
    assert result.startswith(("equal", "rows-only")) and "TYPES" not in result, result


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_oracles())
