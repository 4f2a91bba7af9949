"""Per-file index of the lake: which files can hold a time or a key.

For every file that counts the index keeps its rows, the least and greatest value of the chosen
columns, and for key columns a Bloom filter. A filter is cut into bitmaps of 32,768 bits, as many
as the file needs (``BITS`` bits a row, ``HASHES`` places a key), so that it is built and asked by
built-in bitmap functions alone. A query asks the index first and opens only the files that may
match; parts written since the index was made are always opened, so the answer never depends on it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake.sources import generations as G
from brinelake.sources import lake

BLOCK, BITS, HASHES = 32768, 10, 3
_FOLDER = "_index"


def _places(value: Column) -> Column:
    """The places of a key in a filter of ``blocks`` bitmaps, as (block, bit)."""
    at = [F.pmod(F.xxhash64(F.lit(k), value.cast("string")), F.col("blocks") * BLOCK) for k in range(HASHES)]
    return F.array(*[F.struct(F.floor(x / BLOCK).cast("int").alias("block"), (x % BLOCK).alias("bit")) for x in at])


def _index(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    paths = G.names(spark, f"{folder}/{_FOLDER}/{table}/*")
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def _indexed_pairs(facts: DataFrame | None) -> set[tuple[str, str]]:
    """(part, day) with an entry; as many as there are folders."""
    return set() if facts is None else {tuple(r) for r in facts.select("part", F.col("date").cast("string")).distinct().collect()}


def index_files(spark: SparkSession, base: str, record_type: str, ranges: list[str], keys: list[str]) -> None:
    """Index the parts of a type that have no entry yet.

    Two passes over the named columns only: rows and ranges per file, then the filters.
    """
    folder, columns = f"{base.rstrip('/')}/{record_type}", list(dict.fromkeys([*ranges, *keys]))
    now = G.ensured(spark, folder)
    pairs = now.pairs() - _indexed_pairs(_index(spark, folder, "facts"))
    if not pairs:
        return
    rows = lake.read_pairs(spark, folder, now, pairs, positions=True).select("date", F.col("_file").alias("file"), *columns)
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    facts = rows.groupBy("date", "file").agg(F.count(F.lit(1)).alias("rows"), *ends).withColumns({
        "part": F.regexp_extract("file", r"/batch_id=([^/]+)/", 1), "blocks": F.ceil(F.col("rows") * BITS / BLOCK)})
    name = uuid.uuid4().hex
    facts.write.parquet(f"{folder}/{_FOLDER}/facts/{name}")
    facts = spark.read.parquet(f"{folder}/{_FOLDER}/facts/{name}")
    sized = rows.join(facts.select("file", "blocks"), "file")
    told = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in keys])
    bits = (sized.select("file", "blocks", F.inline(told)).where(F.col("value").isNotNull())
            .select("file", "key", F.inline(_places(F.col("value")))))
    bits.groupBy("file", "key", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.parquet(
        f"{folder}/{_FOLDER}/filters/{name}")


def matching_files(facts: DataFrame, filters: DataFrame, equal: dict[str, object], between: dict[str, tuple]) -> DataFrame:
    """(file,) of the indexed files that may hold a row with these values and in these ranges."""
    tests = [F.lit(True)]
    for c, (a, b) in [*((c, (v, v)) for c, v in equal.items()), *between.items()]:
        if f"lo_{c}" in facts.columns:
            tests += [] if a is None else [F.col(f"hi_{c}") >= F.lit(a)]
            tests += [] if b is None else [F.col(f"lo_{c}") <= F.lit(b)]
    found = facts.where(reduce(lambda x, y: x & y, tests))
    byte = F.expr("CAST(conv(hex(substring(bitmap, CAST(bit div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    for c, value in equal.items():
        own = filters.where(F.col("key") == c).select("file", "block", "bitmap")
        if own.isEmpty():
            continue
        asked = found.select("file", F.inline(_places(F.lit(value).cast(facts.schema[f"lo_{c}"].dataType))))
        held = asked.join(own, ["file", "block"], "left").withColumn("byte", F.coalesce(byte, F.lit(0)))
        sure = held.groupBy("file").agg(F.bool_and(F.expr("shiftright(byte, CAST(bit % 8 AS INT)) % 2 = 1")).alias("may"))
        found = found.join(sure.where("may").select("file"), "file", "left_semi")
    return found.select("file")


def read_matching(spark: SparkSession, base: str, record_type: str, equal: dict[str, object] | None = None,
                  between: dict[str, tuple] | None = None) -> DataFrame:
    """Rows with these values and in these ranges (both ends in, None open); other files stay shut.

    The names of the files that may match come to the driver, which has to name them to the reader.
    """
    folder = f"{base.rstrip('/')}/{record_type}"
    equal, between = equal or {}, between or {}
    now = G.ensured(spark, folder)
    facts, filters = _index(spark, folder, "facts"), _index(spark, folder, "filters")
    pairs, known = now.pairs(), _indexed_pairs(facts)
    found = {r.file for r in matching_files(facts, filters, equal, between).collect()} if known else set()
    counting = {G.part_path("", p, d).lstrip("/") for p, d in pairs & known}
    chosen = {f for f in found if f.rsplit("/", 1)[0] in counting}
    df = lake.read_pairs(spark, folder, now, pairs - known, files=chosen)
    for c, value in equal.items():
        df = df.where(F.col(c) == F.lit(value))
    for c, (a, b) in between.items():
        df = df if a is None else df.where(F.col(c) >= F.lit(a))
        df = df if b is None else df.where(F.col(c) <= F.lit(b))
    return df
