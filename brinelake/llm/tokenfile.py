"""Token ids in compressed files with random access: Re-Pair grammars per shard.

A shard is a run of whole documents in ascending id order, about a million ids. In a shard the
frequent pairs of adjacent symbols are replaced by new symbols, again and again, until no pair is
frequent; the rules, the final sequence and the expansion length of every symbol are stored. A
position is found by binary search in the running sum of expansion lengths, so ids can be read
from the middle of a shard by expanding only the symbols there.

Format: a Parquet data set with one row per shard: ``part`` and ``n`` (order of the shards),
``first`` (ids of the part before the shard), ``doc_ids``, ``doc_tokens`` (lengths, end ids included), ``n_tokens``, ``terminals`` (symbols from
this number on are rules), ``rules`` (pairs of unsigned 32-bit numbers), ``sequence`` (unsigned
32-bit numbers) and ``lengths`` (expansion length per rule). Spark's writer commits whole files,
so a lost executor costs its own shards only.

Defined cases: null and empty texts hold the end id alone; null ids come first; documents with
equal ids are ordered by a hash of their text, equal texts are interchangeable; a document longer than a
shard is a shard of its own; an empty table gives an empty data set.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinelake.llm.bpe import byte_letters
from brinelake.llm.common import written

SHARD = 1 << 20
#: A rule takes 12 bytes. On a million ids of the given documents, stored bytes per id are least here:
#: 2.80 (64), 2.45 (16), 2.32 (8), 2.31 (4), 2.72 (2), and 1.163, 1.145, 1.142, 1.224, 1.436 compressed.
LEAST = 8
#: Words and pieces that a worker remembers; about 150 bytes each.
CACHE, PIECES = 700_000, 900_000
#: Letters that only change to lower case on their way to the model, and ASCII punctuation after them.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SLOTS = 20


class _Memory(dict):
    """Ids of single words. One that is not here is made of its pieces if it is a plain one; of the
    others there are no ids as yet, and they are put down in ``new``."""

    def __init__(self, pieces: dict[str, bytes], piece: Callable[[str], bytes]):
        super().__init__()
        self.pieces, self.piece, self.new = pieces, piece, []

    def __missing__(self, w: str) -> bytes:
        if not w:
            self[w] = b""
            return b""
        if len(w) <= 64:
            ascii_word = w.isascii()
            if ascii_word and w.isalpha():
                low = w.lower()
                code = self[w] = self.pieces.get(low) or self.piece(low)
                return code
            run = w.rstrip(_MARKS)
            if run and (run.isalpha() if ascii_word else _LETTERS.fullmatch(run)):
                low, marks = run.lower(), w[len(run):]
                code = self.pieces.get(low) or self.piece(low)
                if marks:
                    code += self.pieces.get(marks) or self.piece(marks)
                self[w] = code
                return code
        self.new.append(w)
        return b""


class WordIds:
    """Ids by the tokenizers library, with a bounded memory of what it gave for single words.

    For vocabularies whose tokens never cross a blank. Words are what stands between blanks and
    line ends. Of new ones, a run of plain letters and the punctuation after it go to the
    library's model as the two pieces they are; all others go through the whole library
    together, parted by a special token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = self.library.get_added_tokens_decoder()
        self.names = [t.content for t in special.values()]
        self.part_id, self.part = max((i, t.content) for i, t in special.items())
        self.size = self.library.get_vocab_size()
        self.pieces: dict[str, bytes] = {}
        self.memory = _Memory(self.pieces, self._piece)
        self.letters = dict(enumerate(byte_letters()))
        self.four = [struct.Struct(f"<{n}I") for n in range(130)]

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        tokens = self.library.model.tokenize(text)
        found = self.pieces[piece] = self.four[len(tokens)].pack(*[t.id for t in tokens])
        return found

    @staticmethod
    def _words(text: str) -> list[str]:
        """What stands between blanks and line ends; nothing where two of them meet."""
        return text.replace("\n", " ").split(" ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if len(self.memory) > CACHE:
            self.memory.clear()
        have, get = self.memory, self.memory.__getitem__
        new = have.new = []
        split = [self._words(t) if t else [] for t in texts]
        out, later = [], []
        for k, ws in enumerate(split):
            known = len(new)
            out.append(b"".join(map(get, ws)))
            if len(new) > known:
                later.append(k)
        if not later:
            return out
        new = set(new)
        # A word that starts with a mark, or holds a special token's name, is encoded with its text.
        odd = {w for w in new if any(n in w for n in self.names)
               or (w and not w[0].isascii() and unicodedata.combining(w[0]))}
        plain = [w for w in new if w not in odd and len(w) <= 64]
        long = {w: self._whole(w) for w in new if w not in odd and len(w) > 64}
        for k in range(0, len(plain), 4096):
            part = plain[k:k + 4096]
            ids = np.array(self.library.encode(self.part.join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.part_id)
            have.update(zip(part, (x.tobytes() for x in np.split(ids, cuts))))
            for w in part[1:]:
                have[w] = have[w][4:]  # less the parting token
        for k in later:
            out[k] = (self._whole(texts[k]) if odd and not odd.isdisjoint(split[k])
                      else b"".join([long[w] if w in long else have[w] for w in split[k]]))
        return out


@lru_cache(maxsize=2)
def words(path: str) -> WordIds:
    return WordIds(path)


def _slot(key: np.ndarray) -> np.ndarray:
    """Place of a pair in tables of 2 ** _SLOTS."""
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).view(np.int64)


def repair(ids: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence) of a grammar for ``ids``.

    A round counts adjacent pairs by sorting them and replaces, from left to right, every pair
    that occurs at least a sixty-fourth as often as the most frequent one; it ends where that falls
    below ``least``. A pair that is rarer than ``least`` stays so, since only pairs with a new symbol
    come up: its places are ``live`` no more, and no later round looks at them.
    """
    seq = ids.astype(np.uint32)
    live = np.ones(len(seq), bool)
    rules: list[np.ndarray] = []
    top = terminals
    while True:
        live[-1:] = False  # the last symbol begins no pair
        place = np.flatnonzero(live)
        if not len(place):
            break
        key = seq[place].astype(np.int64) << 32 | seq[place + 1]
        order = np.sort(key)
        start = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        count = np.diff(np.append(start, len(order)))
        most = int(count.max())
        if most < least:
            break
        frequent = np.zeros(1 << _SLOTS, bool)  # a rare pair in such a slot is only counted again
        frequent[_slot(order[start[count >= least]])] = True
        chosen = order[start[count >= max(least, most // 64)]]
        slot = _slot(chosen)
        _, first = np.unique(slot, return_index=True)  # of pairs in one slot the others wait a round
        chosen, slot = chosen[first], slot[first]
        table = np.full(1 << _SLOTS, -1, np.int32)
        table[slot] = np.arange(len(chosen))
        slot = _slot(key)
        stay = np.flatnonzero(frequent[slot])
        place, key, at = place[stay], key[stay], table[slot[stay]]
        live = np.zeros(len(seq), bool)
        live[place] = True
        hit = np.flatnonzero((at >= 0) & (chosen[at] == key))
        place, at = place[hit], at[hit]
        head = np.concatenate([[True], place[1:] != place[:-1] + 1])
        each = np.arange(len(place))
        odd = (each - np.maximum.accumulate(np.where(head, each, 0))) & 1  # pairs may not share a symbol
        even = np.flatnonzero(odd == 0)
        place, at = place[even], at[even]
        used = np.flatnonzero(np.bincount(at, minlength=len(chosen)))
        new = np.zeros(len(chosen), np.uint32)
        new[used] = top + np.arange(len(used))
        seq[place] = new[at]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        stay = np.flatnonzero(stay)
        seq, live = seq[stay], live[stay]
        place -= np.arange(len(place))
        live[place] = True
        live[place[place > 0] - 1] = True
        rules.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1))
        top += len(used)
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.int64)).astype("<u4"), seq.astype("<u4")


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule stands for. A rule only uses terminals and earlier rules."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals]))
    return np.array(out, "<u4")


class Shard:
    """A stored shard, for reading."""

    def __init__(self, terminals: int, rules: bytes, sequence: bytes, lengths: bytes):
        self.terminals = terminals
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.sequence = np.frombuffer(sequence, "<u4")
        each = np.concatenate([np.ones(1, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.ends = np.cumsum(each[np.maximum(self.sequence.astype(np.int64) - terminals + 1, 0)])

    def _texts(self, symbols: np.ndarray) -> dict[int, bytes]:
        """Expansions of the rules among the symbols, and of those that they need."""
        need = set(symbols.tolist())
        stack = list(need)
        while stack:
            for s in self.rules[stack.pop() - self.terminals].tolist():
                if s >= self.terminals and s not in need:
                    need.add(s)
                    stack.append(s)
        text: dict[int, bytes] = {}
        for s in sorted(need):
            text[s] = b"".join([x.to_bytes(4, "little") if x < self.terminals else text[x]
                                for x in self.rules[s - self.terminals].tolist()])
        return text

    def read(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``end``."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        end = total if end is None else min(end, total)
        if start >= end:
            return np.empty(0, "<u4")
        i, j = np.searchsorted(self.ends, [start, end - 1], "right")
        part = self.sequence[i:j + 1]
        before = int(self.ends[i - 1]) if i else 0
        at = self.ends[i:j + 1] - before  # where each symbol ends
        out = np.empty(int(at[-1]), "<u4")
        plain = part < self.terminals
        out[at[plain] - 1] = part[plain]
        if not plain.all():
            used = (part[~plain] - self.terminals).astype(np.int64)
            among = np.flatnonzero(np.bincount(used))
            text = self._texts(among + self.terminals)
            texts = [text[s + self.terminals] for s in among.tolist()]
            size, begin = np.zeros(among[-1] + 1, np.int64), np.zeros(among[-1] + 1, np.int64)
            size[among] = [len(x) // 4 for x in texts]
            begin[among] = np.cumsum(size[among]) - size[among]
            every, end_at = size[used], at[~plain]
            steps = np.arange(int(every.sum())) - np.repeat(np.cumsum(every) - every, every)
            out[np.repeat(end_at - every, every) + steps] = np.frombuffer(b"".join(texts), "<u4")[np.repeat(begin[used], every) + steps]
        return out[start - before:end - before]


#: Rows of the table of files up to which it is sent to every executor; 16 bytes each.
FEW_FILES = 100_000
_SHARDS = ("part long, n long, first long, doc_ids array<{0}>, doc_tokens array<long>, n_tokens long,"
           " terminals long, rules binary, sequence binary, lengths binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
          text: str = "text", shard: int = SHARD) -> None:
    """Encode every text, append the end id, and write the shards in ascending id order."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, n, first = words(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        names: list = []
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal n, first, size
            ids = np.frombuffer(b"".join(held), "<u4")
            terminals = max(coder.size, end_id + 1)
            rules, seq = repair(ids, terminals)
            row = {"part": part, "n": n, "first": first, "doc_ids": list(names), "doc_tokens": [len(h) // 4 for h in held],
                   "n_tokens": len(ids), "terminals": terminals, "rules": rules.tobytes(),
                   "sequence": seq.tobytes(), "lengths": rule_lengths(rules, terminals).tobytes()}
            n, first, size = n + 1, first + len(ids), 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for batch in batches:
            schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("first", pa.int64()),
                                ("doc_ids", pa.list_(batch.schema.field(0).type)),
                                ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
                                ("terminals", pa.int64()), ("rules", pa.binary()),
                                ("sequence", pa.binary()), ("lengths", pa.binary())])
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 500):
                for i, code in zip(ids[k:k + 500], coder.encode_batch(texts[k:k + 500])):
                    names.append(i)
                    held.append(code + end)
                    size += len(code) // 4 + 1
                    if size >= shard:
                        yield done()
        if held:
            yield done()

    # the hash settles ties; splitters are sampled from the keys, which therefore stay small
    rows = docs.select(doc_id, text, F.xxhash64(text).alias("__tie"))
    (rows.repartitionByRange(doc_id, "__tie").sortWithinPartitions(doc_id, "__tie")
     .select(doc_id, text).mapInArrow(shards, _SHARDS.format(kind))
     .write.mode("overwrite").option("compression", "zstd").parquet(folder))


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, before): ids in the data set before each file, in the order of the files."""
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    return parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))


def read(spark, folder: str) -> DataFrame:
    """Per document of a data set: ``doc_id``, ``start`` and ``ids`` as bytes of 32-bit numbers."""
    shards = spark.read.parquet(folder)
    kind = shards.schema["doc_ids"].dataType.elementType

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, names, sizes, terminals, rules, seq, lengths in zip(
                    *(c.to_pylist() for c in batch.columns)):
                ids = Shard(terminals, rules, seq, lengths).read()
                ends = np.cumsum(sizes)
                parts = [x.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, batch.schema.field(1).type.value_type),
                     pa.array(before + ends - np.array(sizes)), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "ids"])

    schema = T.StructType().add("doc_id", kind).add("start", "long").add("ids", "binary")
    parts = written(part_starts(shards), "token-files")
    parts = F.broadcast(parts) if parts.count() <= FEW_FILES else parts
    return (shards.join(parts, "part")
            .select((F.col("before") + F.col("first")).alias("before"), "doc_ids", "doc_tokens", "terminals", "rules", "sequence", "lengths")
            .mapInArrow(expand, schema))
