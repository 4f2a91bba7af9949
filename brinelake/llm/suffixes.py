"""Exact substring deduplication over sorted suffixes.

A string of 200 bytes that starts at two places is found whatever stands around it. Suffixes are
sorted by the codes of their leading pieces; to keep the sort small, only *anchored* suffixes take
part: of the 32-byte grams in a 200-byte string the one with the smallest hash is its anchor, so
equal strings have equal anchors at equal offsets, and each string start belongs to one anchor.
An anchor carries the starts it owns; together these tile the text, so nothing is left out.

1. Sampled splitters range-partition the anchors by (gram code, code of all owned strings); each
   bucket is sorted by those keys in turn. An anchor beside one with the same codes has every
   owned start repeated. One with only the gram in common goes on, with one anchor of each
   settled code; a group cut by a bucket boundary is never settled by what one side has seen.
2. The owned starts of those are cut into bins whose strings share a core of 144 bytes. Bins are
   range-partitioned and sorted by core, then every string in a core is told apart by the few
   bytes left and right of the core. Strings of cores that lie across a boundary are compared
   across it by their hashes.
3. Covered ranges are merged per document and cut out.

No pair of occurrences is ever formed, and a frequent string is spread over buckets, because
splitters may fall inside a group. Codes are pairs of independent 64-bit polynomial hashes.

Defined cases: null is empty; texts shorter than a string are untouched; matches never cross
documents; overlapping occurrences count; rows with equal ids are different documents; ranges are
judged on the input. Kept bytes may cut a character and are therefore binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.common import release, row_keyed, written

LENGTH = 200
GRAM = 32
BIN = 57
_CORE = LENGTH - BIN + 1
_SPAN = LENGTH - GRAM  # largest offset of an anchor in its string
_KEY = ["__file", "__row"]
#: Rows of one group held in memory; a longer group is handled in parts, as across a boundary.
HELD = 20_000


def _letters(seed: int) -> np.ndarray:
    """256 odd-looking 64-bit values from the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Codes:
    """Polynomial hashes of substrings from running sums, modulo 2**64."""

    def __init__(self, seed: int, base: int):
        self.table = _letters(seed)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, base: int, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = self._powers(self.base, 2 * n), self._powers(self.inverse, 2 * n)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.down[:n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.up[start]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32)) ^ (end - start).astype(np.uint64)


_ONE, _TWO = Codes(1, 0xD1342543DE82EF95), Codes(2, 0x2545F4914F6CDD1D)


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first owned start, last owned start, gram code, code of the owned strings)."""
    one = _ONE.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _ONE.of(one, at, at + GRAM)
    low, width, want = grams, 1, _SPAN + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    ends = np.append(starts[1:], len(low)) - 1
    views = np.lib.stride_tricks.sliding_window_view(grams, want)
    found = []
    while len(starts):
        a = np.concatenate([s + views[s].argmin(1) for s in np.split(starts, range(4096, len(starts), 4096))])
        last = np.minimum(a, ends)
        found.append((a, starts, last))
        more = last < ends  # the same smallest hash again, farther on
        starts, ends = last[more] + 1, ends[more]
    a, first, last = (np.concatenate(x) for x in zip(*found))
    whole = _TWO.of(_TWO.sums(data), first, last + LENGTH)
    return a, first, last, grams[a], whole


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists: list[list[np.ndarray]] = [[], [], []]
        ends, keep = [0], []
        for k, text in enumerate(batch.column(2)):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            if len(data) < LENGTH:
                continue
            a, first, last, gram, whole = anchors(data)
            keep.append(k)
            ends.append(ends[-1] + len(a))
            packed = (a << 16) | ((a - last) << 8) | (a - first)
            for held, x in zip(lists, (gram.view(np.int64), whole.view(np.int64), packed)):
                held.append(x.astype(np.int64))
        if keep:
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1]).take(pa.array(keep)).columns,
                 *[pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in lists]],
                names=[*_KEY, "gram", "whole", "at"])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that share a gram: state 0 all owned starts repeat, 1 the same and stands for its
    code, 2 open. Input is sorted by gram, then by code."""
    names = ["gram", "whole", *_KEY, "at"]

    def settle(cols: list[np.ndarray], head: bool, tail: bool) -> pa.RecordBatch:
        """head, tail: the first and the last group may go on outside."""
        gram, whole = cols[0], cols[1]
        n = len(gram)
        groups, codes = _runs(gram), _runs(gram, whole)
        group_of = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        times = np.repeat(np.diff(codes), np.diff(codes))
        state = np.where(times > 1, 0, 2)
        first = codes[:-1][np.diff(codes) > 1]
        state[first] = 1
        outside = np.zeros(len(groups) - 1, bool)
        outside[0] |= head
        outside[-1] |= tail
        open_ = np.bincount(group_of[state == 2], minlength=len(groups) - 1) > 0
        state[(state == 1) & ~(open_ | outside)[group_of]] = 0
        alone = (np.diff(groups) == 1) & ~outside
        keep = ~alone[group_of] if n else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*cols[2:], state.astype(np.int64))],
                                          names=[*_KEY, "at", "state"])

    held: list[np.ndarray] | None = None
    head = True
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
        if held is not None:
            cols = [np.append(a, b) for a, b in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - cut > HELD:  # a long group: what has come is told as a part of it
            yield settle(cols, head, True)
            held, head = None, True
        else:
            if cut:
                yield settle([c[:cut] for c in cols], head, False)
                head = False
            held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield settle(held, head, True)


def _bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of a document's open and standing anchors, with the bytes around their cores."""
    names = ["core", "core2", *_KEY, "base", "low", "high", "rep", "left", "right"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for file, row, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            packed = np.array([t["at"] for t in todo], np.int64)
            rep = np.array([t["state"] for t in todo]) == 1
            a, omin, omax = packed >> 16, packed >> 8 & 255, packed & 255
            one, two = _ONE.sums(data), _TWO.sums(data)
            for j in range(-(-(_SPAN + 1) // BIN)):
                low, high = np.maximum(omin, j * BIN), np.minimum(omax, (j + 1) * BIN - 1)
                at = np.flatnonzero(low <= high)
                if not len(at):
                    continue
                base = a[at] - j * BIN  # where the core starts
                low, high = low[at] - j * BIN, high[at] - j * BIN
                cores = [c.of(s, base, base + _CORE).view(np.int64).tolist()
                         for c, s in ((_ONE, one), (_TWO, two))]
                b, lo, hi = base.tolist(), low.tolist(), high.tolist()
                for held, x in zip(out, (*cores, [file] * len(b), [row] * len(b), b, lo, hi,
                                         rep[at].tolist(),
                                         [raw[p - h:p] for p, h in zip(b, hi)],
                                         [raw[p + _CORE:p + LENGTH - x] for p, x in zip(b, lo)])):
                    held.extend(x)
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of the bins in a bucket sorted by core: ranges (start, end), or, for cores
    that may go on outside the bucket, strings to be compared there (h1, h2 and the start)."""
    kinds = [pa.int64()] * 6

    def compare(rows: list[tuple], outside: bool, out: list[list]) -> None:
        if len(rows) == 1 and not outside:
            return
        seen: dict[bytes, int] = {}
        strings = []
        for _, _, file, row, base, low, high, rep, left, right in rows:
            mine = [bytes((t,)) + left[len(left) - t:] + b"\0" + right[:BIN - 1 - t]
                    for t in range(low, high + 1)]
            strings.append(mine)
            for key in mine:
                seen[key] = seen.get(key, 0) + 1 + rep
        told: set[bytes] = set()
        core = b"%d %d " % rows[0][:2]
        for (_, _, file, row, base, low, high, rep, _, _), mine in zip(rows, strings):
            again = [seen[key] > 1 for key in mine]
            if not rep:
                k = 0
                while k < len(mine):  # starts go left as offsets grow
                    if again[k]:
                        e = k
                        while e + 1 < len(mine) and again[e + 1]:
                            e += 1
                        for held, x in zip(out, (file, row, base - low - e, base - low - k + LENGTH,
                                                 None, None)):
                            held.append(x)
                        k = e
                    k += 1
            if outside:
                for k, key in enumerate(mine):
                    if not again[k] or key not in told:
                        told.add(key)
                        h = xxhash.xxh3_128_digest(core + key)
                        start = None if again[k] else base - low - k
                        for held, x in zip(out, (file, row, start, None,
                                                 int.from_bytes(h[:8], "little", signed=True),
                                                 int.from_bytes(h[8:], "little", signed=True))):
                            held.append(x)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                          names=[*_KEY, "start", "end", "h1", "h2"])

    group: list[tuple] = []
    head = True
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][:2] != r[:2]:
                compare(group, head, out)
                group, head = [], False
            elif len(group) >= HELD:
                compare(group, True, out)
                group, head = [], True
            group.append(r)
        yield batch_of(out)
    if group:
        out = [[] for _ in kinds]
        compare(group, True, out)
        yield batch_of(out)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(*(c.to_pylist() for c in batch.columns[1:])):
            raw = (text or "").encode()
            kept, last, spans = [], 0, []
            for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            for s, e in spans:
                kept.append(raw[last:s])
                last = e
            kept.append(raw[last:])
            rows.append((len(raw), sum(e - s for s, e in spans), len(spans), b"".join(kept)))
        n, gone, spans, kept = map(list, zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=[batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept"])


def covered(rows: DataFrame, text: str) -> DataFrame:
    """(__file, __row, ranges): the byte ranges of each document that stand elsewhere too."""
    long5 = "__file long, __row long, "
    found = written(rows.select(*_KEY, text).mapInArrow(
        _anchor_rows, long5 + "gram array<long>, whole array<long>, at array<long>"), "anchors")
    keys = ["gram", "whole", *_KEY, "at"]
    each = found.select(*_KEY, F.inline(F.arrays_zip("gram", "whole", "at"))).select(*keys)
    told = written(each.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .mapInArrow(_settle, long5 + "at long, state long"), "anchors-told")
    release(rows.sparkSession)
    todo = (told.where("state > 0").groupBy(*_KEY)
            .agg(F.collect_list(F.struct("at", "state")).alias("todo")))
    bins = written(rows.select(*_KEY, text).join(todo, _KEY).select(*_KEY, text, "todo").mapInArrow(
        _bin_rows, "core long, core2 long, " + long5 + "base long, low long, high long, rep boolean,"
                   " left binary, right binary"), "bins")
    release(rows.sparkSession)
    keys = ["core", "core2", *_KEY, "base"]
    compared = written(bins.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _compare, long5 + "start long, end long, h1 long, h2 long"), "bins-compared")
    release(rows.sparkSession)
    across = compared.where("h1 IS NOT NULL")
    twice = across.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    late = (across.where("start IS NOT NULL").join(twice, ["h1", "h2"])
            .select(*_KEY, "start", (F.col("start") + LENGTH).alias("end")))
    at, omin, omax = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    sure = told.where("state < 2").select(*_KEY, (at - omax).alias("start"),
                                          (at - omin + LENGTH).alias("end"))
    ranges = sure.union(compared.where("end IS NOT NULL").select(*_KEY, "start", "end")).union(late)
    return ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left."""
    rows = row_keyed(docs)
    ranges = covered(rows, text)
    kind = docs.schema[doc_id].dataType
    schema = (T.StructType().add(doc_id, kind).add("n_bytes", "long").add("n_removed", "long")
              .add("n_spans", "long").add("kept", "binary"))
    return (rows.select(*_KEY, doc_id, text).join(ranges, _KEY, "left")
            .select(doc_id, text, "ranges").mapInArrow(_cut, schema))
