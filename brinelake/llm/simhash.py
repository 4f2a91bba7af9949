"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits: bit *k* is one where over half of the XXH64 hashes of the word shingles
have it. Two fingerprints that differ in at most two bits differ in at most two of their eight
bytes, so they agree on the other six: for each of the 28 choices of two bytes to leave out, the
distinct fingerprints are joined on the six that stay, and the distance is verified. Only two
bytes are free in such a block, so no block can hold more than 65,536 fingerprints, however many
documents or near copies there are. A block puts out the edges of a spanning forest of its links,
not its pairs; every link is looked at in just one block.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text
with fewer words than a shingle is one shingle; copies share their fingerprint and are never
paired; a null id is never the smallest. Other columns are carried under names of position, so
that none can clash with a name used here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.common import own_names, restored, row_keyed, written
from brinelake.llm.components import components

SEED = 42
DISTANCE = 2
#: Pairs of bytes left out of a block key; the block's number is the place in this list.
FREE = list(combinations(range(8), 2))
_FREE_MASKS = np.array([(0xFF << 8 * i) | (0xFF << 8 * j) for i, j in FREE], np.uint64)
_MATRIX = 512


def shingle_hashes(text: str | None, size: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of one text in their order; none of a text without a word."""
    data = b" ".join((text or "").encode().lower().split())  # bytes: A-Z and ASCII blanks only
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= size:
        return np.array([digest(data, seed)], np.uint64)
    n = len(starts) - size + 1
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(starts, ends[size - 1:])),
                       np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    count = np.zeros(64, np.int64)
    for k in range(0, n, 255 * 256):  # 255 ones fit in a byte
        part = hashes[k:k + 255 * 256]
        held = np.zeros(-(-len(part) // 255) * 255, "<u8")
        held[:len(part)] = part
        ones = np.unpackbits(held.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
        count += ones.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingle_hashes(text, size, seed))


def fingerprints(text: Column, size: int = 3, seed: int = SEED) -> Column:
    """Fingerprint column; the 64 bits are held in a signed long."""

    @F.arrow_udf(T.LongType())
    def prints(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            found = np.fromiter((fingerprint(t.as_py(), size, seed) for t in array),
                                np.uint64, len(array))
            yield pa.array(found.view(np.int64))

    return prints(text)


def _canonical(diff: np.ndarray, free: int) -> np.ndarray:
    """Whether links with these differing bits belong to this block: both free bytes differ, or
    the one that differs is left out first in this block."""
    i, j = FREE[free]
    first, second = (diff & np.uint64(0xFF << 8 * i)) != 0, (diff & np.uint64(0xFF << 8 * j)) != 0
    return (first & second) | (first & ~second & (free == 0)) | (second & ~first & (i == 0))


def _settle(lab: np.ndarray, step) -> np.ndarray:
    """Smallest label reachable: neighbours' minimum, then the label's own label, until stable."""
    while True:
        new = np.minimum(lab, step(lab))
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def forest(prints: np.ndarray, free: int) -> list[tuple[int, int]]:
    """Edges that connect what the links of one block connect: at most one per fingerprint."""
    m = len(prints)
    if m <= _MATRIX:
        diff = prints[:, None] ^ prints[None, :]
        link = (np.bitwise_count(diff) <= DISTANCE) & _canonical(diff, free)
        if not link.any():
            return []
        lab = _settle(np.arange(m), lambda x: np.where(link, x[None, :], m).min(1))
    else:  # the two free bytes say everything: look up all words within the distance
        i, j = FREE[free]
        word = ((prints >> np.uint64(8 * i) & np.uint64(255)) << np.uint64(8)
                | prints >> np.uint64(8 * j) & np.uint64(255)).astype(np.int64)
        place = np.full(1 << 16, m)
        place[word] = np.arange(m)
        masks = [a for a in range(1, 1 << 16) if a.bit_count() <= DISTANCE
                 and ((a >> 8 and a & 255) or (a >> 8 and free == 0) or (not a >> 8 and i == 0))]

        def step(x: np.ndarray) -> np.ndarray:
            held = np.append(x, m)
            best = x.copy()
            for a in masks:
                np.minimum(best, held[place[word ^ a]], out=best)
            return best

        lab = _settle(np.arange(m), step)
    moved = np.flatnonzero(lab != np.arange(m))
    return list(zip(prints[moved].view(np.int64).tolist(), prints[lab[moved]].view(np.int64).tolist()))


def _block_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of the blocks in a partition that is sorted by block."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def edges(free: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        key = prints & ~_FREE_MASKS[free]
        new = np.flatnonzero((free[1:] != free[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(prints)))
        two = starts[sizes == 2]
        diff = prints[two] ^ prints[two + 1]
        near = np.bitwise_count(diff) <= DISTANCE
        at, diff = two[near], diff[near]
        left, right = [], []
        for f in np.unique(free[at]).tolist():
            own = (free[at] == f) & _canonical(diff, f)
            left += prints[at[own]].view(np.int64).tolist()
            right += prints[at[own] + 1].view(np.int64).tolist()
        for k in np.flatnonzero(sizes > 2).tolist():
            found = forest(prints[starts[k]:starts[k] + sizes[k]], int(free[starts[k]]))
            left += [a for a, _ in found]
            right += [b for _, b in found]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                          names=["a", "b"])

    for batch in batches:
        free = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        prints = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if held is not None:
            free, prints = np.append(held[0], free), np.append(held[1], prints)
        if not len(free):
            continue
        key = prints & ~_FREE_MASKS[free]
        last = (free != free[-1]) | (key != key[-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = free[cut:], prints[cut:]
        if cut:
            yield edges(free[:cut], prints[:cut])
    if held is not None and len(held[0]):
        yield edges(*held)


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Links (a, b) among the fingerprints of a table of distinct ones, as spanning forests."""
    keys = F.array(*[F.struct(F.lit(k).alias("free"),
                              F.col(column).bitwiseAND(F.lit(int(np.int64(~m.view(np.int64)))))
                              .alias("key")) for k, m in enumerate(_FREE_MASKS)])
    blocks = prints.select(F.col(column).alias("fp"), F.inline(keys))
    return (blocks.repartition("free", "key").sortWithinPartitions("free", "key", "fp")
            .select("free", "fp").mapInArrow(_block_edges, "a long, b long"))


def grouped(prints: DataFrame, by: list[str], fp: str = "fp") -> DataFrame:
    """(fp, first): per distinct fingerprint the smallest ``struct(by)`` of its group."""
    reps = written(prints.groupBy(fp).agg(F.min(F.struct(*by)).alias("least")), "simhash-reps")
    roots = components(links(reps.select(fp), fp)).select(F.col("node").alias(fp), "root")
    placed = written(reps.join(roots, fp, "left")
                     .select(fp, "least", F.coalesce("root", F.col(fp)).alias("root")), "simhash-roots")
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    return placed.join(first, "root").select(fp, "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3,
                    seed: int = SEED) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the smallest id of its group."""
    prints = written(docs.select(F.col(doc_id).alias("id"), fingerprints(F.col(text), size, seed).alias("fp")),
                     "simhash-prints")
    groups = grouped(prints.select(F.col("id").isNull().alias("none"), "id", "fp"), ["none", "id"])
    return (prints.join(groups, "fp")
            .select(F.col("id").alias(doc_id), "fp", F.col("first.id").alias("component_id")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3,
                 seed: int = SEED) -> DataFrame:
    """One row of each group of near duplicates, with the columns it came with.

    The row with the smallest id stays (null ids last), and of repeated rows the first in its file.
    """
    inner, name = own_names(docs)
    rows = row_keyed(inner)
    by = ["none", "id", "__file", "__row"]
    prints = written(rows.select(F.col(name[doc_id]).isNull().alias("none"), F.col(name[doc_id]).alias("id"),
                                 "__file", "__row", fingerprints(F.col(name[text]), size, seed).alias("fp")),
                     "simhash-prints")
    firsts = grouped(prints, by).select("first.__file", "first.__row").distinct()
    return restored(rows.join(firsts, ["__file", "__row"], "left_semi"), docs)
