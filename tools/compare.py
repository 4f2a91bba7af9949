"""Run queries in Spark and their SQL twins in DuckDB and compare every value.

    python tools/compare.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from brinelake.session import local_session  # noqa: E402
from driver_queries import all_oracles, all_queries  # noqa: E402
from driver_queries.frames import TABLES  # noqa: E402

KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "double",
         "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date"}
SPARK = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "timestamp_ntz": "timestamp"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return float(v) if isinstance(v, Decimal) else v


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    t0 = time.time()
    df = all_queries()[name](spark, folder)
    cols = sorted(df.columns)
    left = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    t1 = time.time()
    sql = all_oracles().get(name)
    if sql is None:
        return f"rows-only {sum(left.values())} rows, {t1 - t0:.1f}s"
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    kinds = {d[0]: KINDS.get(d[1], d[1]) for d in desc}
    mine = {n: SPARK.get(t, t) for n, t in df.dtypes}
    if sorted(kinds) != cols:
        return f"COLUMNS {cols} vs {sorted(kinds)}"
    wrong = {c: (mine[c], kinds[c]) for c in cols if mine[c] != kinds[c]}
    names = [d[0] for d in desc]
    place = [names.index(c) for c in cols]
    right = Counter(tuple(plain(r[i]) for i in place) for r in con.execute(sql).fetchall())
    if left != right:
        only_l, only_r = list((left - right).items())[:3], list((right - left).items())[:3]
        return (f"VALUES {sum(left.values())} vs {sum(right.values())} rows\n   {cols}\n   spark {only_l}"
                f"\n   duckdb {only_r}")
    note = f" TYPES {wrong}" if wrong else ""
    return f"equal {sum(left.values())} rows, {t1 - t0:.1f}s{note}"


def main() -> int:
    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), database(folder)
    bad = 0
    for name in all_queries():
        if parts and not any(p in name for p in parts):
            continue
        try:
            result = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            result = f"FAILED {type(e).__name__}: {str(e)[:1200]}"
        bad += not result.startswith(("equal", "rows-only")) or "TYPES" in result
        print(f"{name}: {result}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
