"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c) of each other, and within epsilon
in any set of orthonormal directions. Vectors are laid in cells of side epsilon on the leading
principal directions and sorted by label and cell; the sorted sequence is cut into blocks. A tree
over the sequence holds the bounding box of every interval, and intervals are joined with
themselves from the root down: a pair of intervals whose boxes are farther apart than epsilon is
dropped with all that is below it. The pairs of blocks that stay are compared by matrix product in
double precision. A pair of blocks puts out link counts per vector and the edges of a spanning
forest, never its pairs of vectors.

Copies are one vector with a count, so a group of copies costs what one vector costs. A dense
group of different vectors costs its block pairs, dealt over all tasks.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and
rows with a null label, link with nothing; vectors of different lengths do not link; a repeated
row is another vector; a component's id is the smallest id in it that is not null; an empty table
gives an empty table. Columns other than id, vector and label are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.common import written
from brinelake.llm.components import components

LEADING = 6
BLOCK = 512
FAN_BITS = 4


def _usable(vec: np.ndarray | None) -> bool:
    return (vec is not None and len(vec) > 0 and bool(np.isfinite(vec).all()) and bool(vec.any()))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe against overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _packed(code: str):
    """Vectors as bytes of one kind of number; null where they cannot link."""

    @F.arrow_udf(T.BinaryType())
    def pack(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            out = []
            for x in array:
                v = None
                if x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False).astype(code)
                    if code[1] == "f":
                        v = v + 0.0  # one zero
                out.append(v.tobytes() if _usable(v) else None)
            yield pa.array(out, pa.binary())

    return pack


def _matrix(blobs: list[bytes], code: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), code).reshape(len(blobs), -1)


def _directions(vectors: DataFrame, code: str, leading: int) -> dict[int, np.ndarray]:
    """Per vector length the leading principal directions: eigenvectors of the second moments.

    The moments are summed over all vectors; a square of the vector length comes to the driver.
    """
    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for b in batch.column(0).to_pylist():
                by.setdefault(len(b), []).append(b)
            for size, blobs in by.items():
                u = units(_matrix(blobs, code))
                sums[size] = sums.get(size, 0) + u.T @ u
        for size, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, size), pa.int32()), pa.array(np.arange(m.size), pa.int32()),
                 pa.array(m.ravel())], names=["size", "at", "s"])

    total = (vectors.select("vec").mapInArrow(moments, "size int, at int, s double")
             .groupBy("size", "at").agg(F.sum("s").alias("s")).collect())
    found: dict[int, dict[int, float]] = {}
    for r in total:
        found.setdefault(r["size"], {})[r["at"]] = r["s"]
    out = {}
    for size, cells in found.items():
        d = math.isqrt(len(cells))
        m = np.array([cells[k] for k in range(d * d)]).reshape(d, d)
        _, axes = np.linalg.eigh((m + m.T) / 2)
        out[size] = axes[:, ::-1][:, :leading]
    return out


def _project(axes: dict[int, np.ndarray], code: str, leading: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            blobs = array.to_pylist()
            out = np.zeros((len(blobs), leading))
            for size in set(map(len, blobs)):
                at = [k for k, b in enumerate(blobs) if len(b) == size]
                y = units(_matrix([blobs[k] for k in at], code)) @ axes[size]
                out[at, :y.shape[1]] = y
            ends = np.arange(len(blobs) + 1) * leading
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()))

    return project


def _blocks(leading: int, size: int):
    """Consecutive vectors of one label and length, cut into blocks with their boxes."""
    names = ["part", "n", "label", "dim", *[f"lo{k}" for k in range(leading)],
             *[f"hi{k}" for k in range(leading)], "keys", "copies", "vecs"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal n
            y = np.array([r[5] for r in held])
            row = [part, n, held[0][0], held[0][1], *y.min(0).tolist(), *y.max(0).tolist(),
                   np.array([r[2] for r in held], "<i8").tobytes(),
                   np.array([r[3] for r in held], "<i8").tobytes(), b"".join(r[4] for r in held)]
            n += 1
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == size or held[0][:2] != row[:2]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("label", pa.string()),
                        ("dim", pa.int32()), *[(c, pa.float64()) for c in names[4:-3]],
                        *[(c, pa.binary()) for c in names[-3:]]])
    kinds = ", ".join(["part long", "n long", "label string", "dim int",
                       *[f"{c} double" for c in names[4:-3]], *[f"{c} binary" for c in names[-3:]]])
    return cut, kinds


def block_pairs(blocks: DataFrame, epsilon: float, leading: int = LEADING) -> DataFrame:
    """(a, b), a <= b: the blocks whose boxes are within epsilon, found from the root down."""
    top = blocks.agg(F.max("n"), F.max("part")).first()
    inner = max(1, -(-int(top[0] or 0).bit_length() // FAN_BITS)) * FAN_BITS
    levels = inner // FAN_BITS + max(1, -(-int(top[1] or 0).bit_length() // FAN_BITS))
    place = F.shiftleft("part", inner) + F.col("n")
    lows, highs = [f"lo{k}" for k in range(leading)], [f"hi{k}" for k in range(leading)]
    leaf = blocks.select("label", "dim", place.alias("pos"), *lows, *highs)

    def nodes(level: int) -> DataFrame:
        at = F.shiftright("pos", level * FAN_BITS)
        return leaf.groupBy("label", "dim", at.alias("pos")).agg(
            *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])

    pairs = nodes(levels).select("label", "dim", F.col("pos").alias("a"), F.col("pos").alias("b"))
    for level in range(levels - 1, -1, -1):
        here = nodes(level)
        up = F.shiftright("pos", FAN_BITS)
        sides = []
        for s in "ab":
            sides.append(here.select("label", "dim", up.alias(s), F.col("pos").alias(f"{s}_pos"),
                                     *[F.col(c).alias(f"{s}_{c}") for c in lows + highs]))
        apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"),
                                      F.col(f"a_lo{k}") - F.col(f"b_hi{k}")), F.lit(2.0))
                     for k in range(leading)), F.lit(0.0))
        pairs = (pairs.join(sides[0], ["label", "dim", "a"]).join(sides[1], ["label", "dim", "b"])
                 .where((F.col("a_pos") <= F.col("b_pos")) & (apart <= epsilon * epsilon))
                 .select("label", "dim", F.col("a_pos").alias("a"), F.col("b_pos").alias("b")))
        pairs = written(pairs, "ego-pairs")
    return pairs.select(F.shiftright("a", inner).alias("a_part"),
                        F.col("a").bitwiseAND(F.lit((1 << inner) - 1)).alias("a_n"),
                        F.shiftright("b", inner).alias("b_part"),
                        F.col("b").bitwiseAND(F.lit((1 << inner) - 1)).alias("b_n"))


def _compare(code: str, cosine: float):
    """Counts (a, null, n) and forest edges (a, b, null) of pairs of blocks."""

    def linked(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = link.shape
        a, b = np.arange(rows), (np.arange(cols) if same else np.arange(cols) + rows)
        none = rows + cols
        while True:
            x = np.minimum(a, np.where(link, b[None, :], none).min(1))
            y = x if same else np.minimum(b, np.where(link, x[:, None], none).min(0))
            if np.array_equal(x, a) and np.array_equal(y, b):
                return a, b
            a, b = x, y

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, count = [], [], []
            for same, ka, ca, va, kb, cb, vb in zip(*(c.to_pylist() for c in batch.columns)):
                ids = [np.frombuffer(ka, "<i8"), np.frombuffer(kb, "<i8")]
                copies = [np.frombuffer(ca, "<i8"), np.frombuffer(cb, "<i8")]
                ua, ub = (units(np.frombuffer(v, code).reshape(len(i), -1)) for v, i in zip((va, vb), ids))
                link = ua @ ub.T >= cosine
                if same:
                    link &= ~np.eye(len(link), dtype=bool)
                if not link.any():
                    continue
                for k, found in ((0, link @ copies[1]),) if same else (
                        (0, link @ copies[1]), (1, copies[0] @ link)):
                    at = np.flatnonzero(found)
                    left += ids[k][at].tolist()
                    right += [None] * len(at)
                    count += found[at].tolist()
                a, b = linked(link, same)
                every = ids[0] if same else np.concatenate(ids)
                roots = a if same else np.concatenate([a, b])
                moved = np.flatnonzero(roots != np.arange(len(every)))
                left += every[moved].tolist()
                right += every[roots[moved]].tolist()
                count += [None] * len(moved)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(count, pa.int64())],
                names=["a", "b", "n"])

    return compare


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cosine: float = 0.98, leading: int = LEADING,
                    block: int = BLOCK) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept``."""
    kind = vectors.schema[vector].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    rows = written(vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"),
                                  _packed(code)(F.col(vector)).alias("vec")), "ego-rows")
    able = F.col("vec").isNotNull() & F.col("label").isNotNull()
    distinct = written(rows.where(able).groupBy("label", "vec").agg(
        F.count("*").alias("copies"), F.min("id").alias("first"))
        .withColumn("key", F.monotonically_increasing_id()), "ego-vectors")

    axes = _directions(distinct, code, leading)
    laid = distinct.withColumn("y", _project(axes, code, leading)(F.col("vec")))
    laid = written(laid.select(
        "label", F.octet_length("vec").alias("dim"), "key", "copies", "vec", "y",
        F.transform("y", lambda c: F.floor(c / epsilon)).alias("cell")), "ego-laid")
    cut, kinds = _blocks(leading, block)
    order = ["label", "dim", "cell", "key"]
    blocks = written(laid.repartitionByRange(*order).sortWithinPartitions(*order)
                     .select("label", "dim", "key", "copies", "vec", "y")
                     .mapInArrow(cut, kinds), "ego-blocks")
    pairs = block_pairs(blocks, epsilon, leading)
    for s in "ab":
        pairs = pairs.join(blocks.select(
            F.col("part").alias(f"{s}_part"), F.col("n").alias(f"{s}_n"),
            *[F.col(c).alias(f"{s}_{c}") for c in ("keys", "copies", "vecs")]), [f"{s}_part", f"{s}_n"])
    same = (F.col("a_part") == F.col("b_part")) & (F.col("a_n") == F.col("b_n"))
    found = written(pairs.select(same.alias("same"), *[f"{s}_{c}" for s in "ab"
                                                       for c in ("keys", "copies", "vecs")])
                    .mapInArrow(_compare(code, cosine), "a long, b long, n long"), "ego-links")

    count = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL"))
    placed = written(distinct.select("label", "vec", "key", "copies", "first").join(count, "key", "left")
                     .join(roots.withColumnRenamed("node", "key"), "key", "left")
                     .select("label", "vec", "copies", "first", "others",
                             F.coalesce("root", "key").alias("root")), "ego-placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    told = placed.join(least, "root").select(
        "label", "vec", "component_id",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = F.when(able, F.col("component_id")).otherwise(F.col("id"))
    return (rows.join(told, ["label", "vec"], "left")
            .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept")))
