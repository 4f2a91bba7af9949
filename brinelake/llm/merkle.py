"""Merkle manifest of a table: a root that stands for every row, and a proof for each.

A row is a leaf: the SHA-256 of its fields, each with its length. Per tree (language) the leaves
ascend by id; every eight consecutive nodes become the digest of their digests, until one is left.
These subroots, in the order of their trees, are the leaves of a last tree, whose end is the root.

The built levels are stored as parent-linked rows: a run of up to eight nodes is one row with the
nodes' digests, its place (tree, level, number) and the place of the node that it makes. A recursive
query starts with all leaves and joins them, step by step, with the runs that they lie in: it
appends the other digests of the run to the proof and folds the (perhaps changed) digest with them.
A leaf that has arrived at the root joins nothing more; the query ends when all have. As every
step shuffles the proofs so far, rows above the leaves also hold the runs above their own, and a
step from there climbs up to ``STEP`` levels; of an ended proof only the digest goes on.

Places come from a range partition by (tree, id) and counts per partition, so no tree, however
large, goes through one task. Levels are an eighth of the one below. The proofs are carried as
bytes, half as long as their text.

Defined cases: null fields are a dash and differ from empty ones; a null tree is a tree of its own,
first; null ids come first in their tree; rows with equal ids are ordered by their leaf, equal ones
are interchangeable; a tree of one leaf has that leaf as its subroot, one tree's subroot is the root,
and the digest of an empty proof is that of the empty text; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brinelake.llm.common import written

RUN = 8
#: Levels that a step of the recursive query climbs, but for the first step, which climbs one.
STEP = 8
#: The last tree, whose leaves are the subroots.
TOP = -1
#: A recursive query may give so many rows unless the session says otherwise.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value; numbers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``i``, their place from 0 in the group, by range partitions and their counts.

    ``rows`` has to come from a written table. The last of ``order`` should tell all rows apart, so
    that a frequent key can be cut over partitions.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    before = counts.select(F.col(group).alias("_g"), F.col("part").alias("_p"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("part", group).orderBy(*keys[1:])
    placed = dealt.withColumn("k", F.row_number().over(inside) - 1)
    return (placed.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
            .withColumn("i", (F.col("before") + F.col("k")).cast("long")).drop("part", "_g", "_p", "before", "k"))


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """One row per run of a level: tree, level, number, the digests one after the other."""
    kids = F.array_sort(F.collect_list(F.struct("i", F.lower(F.hex("hash")).alias("hash"))))  # RUN at most
    runs = nodes.groupBy("tree", F.expr(f"i div {RUN}").alias("up")).agg(kids.alias("kids"))
    return runs.select("tree", F.lit(level).alias("level"), "up", F.unhex(F.array_join("kids.hash", "")).alias("run"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of all levels of a forest, and what is left of each tree: (tree, hash, level).

    ``nodes`` has ``tree``, ``i`` and ``hash`` (bytes).  A tree that is down to one node is not climbed.
    """
    levels, ends, level = [], [], 0
    while True:
        sizes = nodes.groupBy("tree").agg(F.max("i").alias("last"))
        marked = nodes.join(sizes, "tree")
        ends.append(marked.where(F.col("last") == 0).select("tree", "hash", F.lit(level).alias("level")))
        more = marked.where(F.col("last") > 0).drop("last")
        runs = written(_runs(more, level), "merkle-runs")
        if runs.isEmpty():
            break
        levels.append(runs)
        nodes = runs.select("tree", F.col("up").alias("i"), F.unhex(F.sha2(F.lower(F.hex("run")), 256)).alias("hash"))
        level += 1
    left = ends[0]
    for e in ends[1:]:
        left = left.unionByName(e)
    return levels, written(left, "merkle-ends")


@contextmanager
def _no_row_limit(spark: SparkSession) -> Iterator[None]:
    """A climb gives one row per leaf and level; the number of levels is bounded, that of rows is not."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed leaves, linked runs, and (tree, tree_key, subroot, root, levels) of ``leaves``.

    ``leaves``, a written table, has ``tree_key``, ``id``, ``leaf`` (bytes) and ``no``, which tells
    rows apart. The leaves come back with ``tree`` and ``i``; runs are (tree, level, up, run,
    up_tree, up_level, up_i), where ``up_tree`` is null for the run that makes the root.
    """
    trees = written(leaves.select("tree_key").distinct(), "merkle-trees")
    trees = written(numbered(trees.withColumn("all", F.lit(0)), "all", "tree_key")
                    .select("tree_key", F.col("i").alias("tree")), "merkle-order")
    ranked = leaves.join(trees.withColumnRenamed("tree_key", "key"), F.col("tree_key").eqNullSafe(F.col("key")))
    placed = written(numbered(ranked.drop("key", "tree_key"), "tree", "id", "leaf", "no").drop("no"), "merkle-leaves")
    lower, subroots = climbed(placed.select("tree", "i", F.col("leaf").alias("hash")))
    upper, root = climbed(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), "hash"))
    last = root.select(F.col("hash").alias("root"), F.col("level").alias("top_levels"))  # one row, or none

    runs = placed.sparkSession.createDataFrame([], "tree long, level int, up long, run binary")
    for part in (*lower, *upper):
        runs = runs.unionByName(part)
    depth = subroots.select("tree", F.col("level").alias("levels")).crossJoin(F.broadcast(last.select("top_levels")))
    depth = depth.unionByName(last.select(F.lit(TOP).cast("long").alias("tree"), F.col("top_levels").alias("levels"),
                                          "top_levels"))
    linked = runs.join(depth, "tree")
    done = F.col("level") + 1 >= F.col("levels")
    at_top = (F.col("tree") == TOP) | (F.col("top_levels") == 0)
    linked = linked.select(
        "tree", "level", "up", "run",
        F.when(~done, F.col("tree")).when(~at_top, F.lit(TOP)).cast("long").alias("up_tree"),
        F.when(~done, F.col("level") + 1).when(~at_top, 0).alias("up_level"),
        F.when(~done, F.col("up")).when(~at_top, F.col("tree")).alias("up_i"))
    ends = (subroots.join(trees, "tree").crossJoin(F.broadcast(last))
            .select("tree", "tree_key", F.col("hash").alias("subroot"), "root", F.col("level").alias("levels"), "top_levels"))
    return placed, written(linked, "merkle-links"), written(ends, "merkle-roots")


def _strides(links: DataFrame) -> DataFrame:
    """Rows with ``path``, their own run and those above it with the places in them, and the place
    that the climb has arrived at."""
    own = F.array(F.struct("run", F.lit(0).alias("at")))
    begin = (F.col("level") == 0) & (F.col("tree") != TOP)
    links = links.withColumn("path", own)
    now = links.where(~begin & ((F.col("level") % STEP == 1) | (F.col("tree") == TOP)))
    for _ in range(STEP - 1):
        above = links.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("up").alias("u"), F.col("run").alias("r"),
                             F.col("up_tree").alias("t2"), F.col("up_level").alias("l2"), F.col("up_i").alias("i2"))
        met = F.col("t").isNotNull()
        longer = F.concat("path", F.array(F.struct(F.col("r").alias("run"), F.expr(f"CAST(up_i % {RUN} AS INT)").alias("at"))))
        now = now.join(above, (F.col("up_tree") == F.col("t")) & (F.col("up_level") == F.col("l"))
                       & (F.expr(f"up_i div {RUN}") == F.col("u")), "left").select(
            "tree", "level", "up", F.when(met, longer).otherwise(F.col("path")).alias("path"),
            *[F.when(met, F.col(b)).otherwise(F.col(a)).alias(a)
              for a, b in (("up_tree", "t2"), ("up_level", "l2"), ("up_i", "i2"))])
    return written(now.unionByName(links.where(begin).select(*now.columns)), "merkle-strides")


def folds(spark: SparkSession, start: DataFrame, links: DataFrame) -> DataFrame:
    """(home, id, leaf, proof_sha256, folded) of every leaf by the recursive query.

    ``start`` has ``home``, ``id`` and ``leaf``, the first place (``tree``, ``level``, ``i``; tree
    null if the leaf is the root) and ``folded``, the digest to begin with, as bytes.
    """
    at = f"32 * if(k = 0, CAST(c.i % {RUN} AS INT), x.at)"
    sides = f"transform(l.path, (x, k) -> struct(hex(substring(x.run, 1, {at})) AS l, hex(substring(x.run, {at} + 33)) AS r))"
    proof = f"concat(c.proof, unhex(array_join(transform({sides}, s -> concat(s.l, s.r)), '')))"
    ended = "unhex(sha2(lower(hex({0})), 256))"
    climb = spark.sql(f"""
        WITH RECURSIVE climb(home, id, leaf, tree, level, i, folded, proof) AS (
          SELECT home, id, leaf, tree, level, i, folded, if(tree IS NULL, {ended.format("X''")}, X'') FROM {{start}}
          UNION ALL
          SELECT c.home, c.id, c.leaf, l.up_tree, l.up_level, l.up_i,
                 aggregate({sides}, c.folded, (acc, s) -> unhex(sha2(lower(concat(s.l, hex(acc), s.r)), 256))),
                 if(l.up_tree IS NULL, {ended.format(proof)}, {proof})
          FROM climb c JOIN {{links}} l ON c.tree = l.tree AND c.level = l.level AND c.i div {RUN} = l.up
        )
        SELECT home, id, leaf, proof AS proof_sha256, folded FROM climb WHERE tree IS NULL""",
                      start=start, links=_strides(links))
    with _no_row_limit(spark):
        return written(climb, "merkle-folds")


def proved(docs: DataFrame, fields: list[str], tree: str, order: str,
           instead: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: the tree and id, its leaf, subroot and root, the digest of its proof, and
    the root folded from the row as ``instead`` has it: ``folded_root``, ``verified``."""
    spark = docs.sparkSession
    now = [(instead or {}).get(c, F.col(c)) for c in fields]
    own, changed = F.unhex(leaf_of([F.col(c) for c in fields])), F.unhex(leaf_of(now))
    leaves = written(docs.select(
        F.col(tree).alias("tree_key"), F.col(order).alias("id"), own.alias("leaf"),
        F.when(changed != own, changed).alias("folded"), F.monotonically_increasing_id().alias("no")), "merkle-rows")
    placed, links, ends = manifest(leaves)
    # a tree of one leaf starts as a leaf of the last tree; if that is one tree, it is the root
    alone, only = F.col("levels") == 0, F.col("top_levels") == 0
    start = placed.join(ends, "tree").select(
        F.col("tree").alias("home"), "id", "leaf", F.coalesce("folded", "leaf").alias("folded"),
        F.when(~alone, F.col("tree")).when(~only, F.lit(TOP)).cast("long").alias("tree"),
        F.lit(0).alias("level"), F.when(~alone, F.col("i")).otherwise(F.col("tree")).alias("i"))
    found = folds(spark, start, links)

    def text(c: str, name: str | None = None) -> Column:
        return F.lower(F.hex(c)).alias(name or c)

    return found.join(ends, F.col("home") == F.col("tree")).select(
        F.col("tree_key").alias(tree), F.col("id").alias(order), text("leaf"), text("subroot"), text("root"),
        text("proof_sha256"), text("folded", "folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
