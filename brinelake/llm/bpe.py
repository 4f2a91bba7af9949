"""Byte-level BPE encoding and decoding from a public tokenizer file, without its library.

Method, per distinct word: a contiguous array of part ids with the ranks of adjacent parts beside
it; the minimum rank is found by a scan, the boundary is deleted, and the two neighbouring ranks
are refreshed. Words of one length are held as the rows of one matrix, so a scan is one numpy
call for thousands of words; each step deletes one boundary of every row that still merges. Words
over ``LONG`` bytes use the same rule on a heap, since scans of a long array are quadratic.

Texts are cut before the single blanks and line ends that stand between other characters; no
token crosses those. The pieces are looked up in a bounded cache and only new ones are merged.

Defined cases: null text is the empty text and has no tokens; the strings of special tokens are
those tokens; decoding maps invalid UTF-8 to U+FFFD, as it must for ids that split a character;
null ids decode to the empty text; an id outside the vocabulary is an error. Rows are independent,
so repeated rows, ties and other columns change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONG = 48
CACHED_CHARS = 64
CACHE = 600_000
NO_RANK = np.int32(2**31 - 1)

# Fixed value: the word pattern of the tokenizer's family.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


_ASSIGNED: set[str] = set()


def unassigned(text: str) -> set[str]:
    """Code points of a text that the interpreter's Unicode version has no character for."""
    new = set(text) - _ASSIGNED
    odd = {c for c in new if unicodedata.category(c) == "Cn"}
    _ASSIGNED.update(new - odd)
    return odd


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the others take the code points from 256
    on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteBpe:
    """One loaded vocabulary with its merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.key_ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(zip(left.tolist(), right.tolist()), range(len(merges))))
        grid = self._ranks(np.repeat(self.first, 256), np.tile(self.first, 256))
        self.byte_ranks = grid.reshape(256, 256)
        self._special_cut = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.pieces: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_RANK)

    def _merge_matrix(self, block: np.ndarray) -> list[bytes]:
        """Ids of words of one length, given as the rows of a byte matrix."""
        done: list[bytes] = [b""] * len(block)
        row = np.arange(len(block))
        parts = self.first[block]
        ranks = self.byte_ranks[block[:, :-1], block[:, 1:]]
        while len(row):
            width = parts.shape[1]
            if width == 1:
                low = np.full(len(row), NO_RANK)
            else:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(row)), at]
            ended = low == NO_RANK
            if ended.any():
                for r, ids in zip(row[ended].tolist(), parts[ended].astype("<u4")):
                    done[r] = ids.tobytes()
                go = ~ended
                row, parts = row[go], parts[go]
                if not len(row):
                    break
                ranks, at, low = ranks[go], at[go], low[go]
            i = np.arange(len(row))
            parts[i, at] = self.made[low]
            keep = np.ones(parts.shape, bool)
            keep[i, at + 1] = False
            parts = parts[keep].reshape(len(row), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[i, at] = False
            ranks = ranks[keep].reshape(len(row), width - 2)
            if width > 2:
                for shift in (-1, 0):
                    p = at + shift
                    ok = np.flatnonzero((p >= 0) & (p < width - 2))
                    p = p[ok]
                    ranks[ok, p] = self._ranks(parts[ok, p], parts[ok, p + 1])
        return done

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank_of.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, merged by rank, leftmost first."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
            elif w:
                groups.setdefault(len(w), []).append(i)
        for n, at in groups.items():
            block = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n)
            for i, ids in zip(at, self._merge_matrix(block)):
                out[i] = ids
        return out

    @staticmethod
    def split(piece: str) -> list[str]:
        """Words of a piece. Code points without a Unicode character are neither letter nor digit."""
        odd = None if piece.isascii() else unassigned(piece)
        if not odd:
            return WORD.findall(piece)
        seen = piece.translate(dict.fromkeys(map(ord, odd), "\x01"))
        return [piece[m.start():m.end()] for m in WORD.finditer(seen)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those of one blank and one run are split in one pass over their union:
        no word crosses from one to the next, and each begins with the only blank of its run."""
        plain = [k for k, p in enumerate(pieces)
                 if p[0] == " " and len(p) <= CACHED_CHARS and p.split() == [p[1:]]]
        found: list[list[bytes]] = [[] for _ in pieces]
        at = iter(plain)
        now: list[bytes] = []
        for w in self.split("".join([pieces[k] for k in plain])):
            if w[0] == " ":
                now = found[next(at)]
            now.append(w.encode())
        rest = set(range(len(pieces))).difference(plain)
        for k in rest:
            found[k] = [w.encode() for w in self.split(pieces[k])]
        distinct = list({w for ws in found for w in ws})
        ids = dict(zip(distinct, self.merge(distinct)))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in found]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the pieces of a text: a first blank is left out, and marks what has none.

        A key is the piece without its leading blank; a piece that does not start with a blank
        before another character has U+0000 in front of it, unless it starts with a line end.
        """
        runs = text.split()
        blanks = text.count(" ") + text.count("\n")
        if (len(runs) == blanks + 1 and sum(map(len, runs)) + blanks == len(text)
                and "\0" not in text):  # each blank is a single space or line end between others
            keys = text.replace("\n", " \n").split(" ") if "\n" in text else runs
            keys[0] = "\0" + keys[0]
            return keys
        return [p[1:] if p[0] == " " and p[1:2] not in ("\n", "\0") else
                p if p[0] == "\n" else "\0" + p for p in _CUT.split(text) if p]

    @staticmethod
    def piece(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        plan: list[list] = []
        for text in texts:
            if not text:
                plan.append([])
                continue
            segments = self._special_cut.split(text) if self._special_cut else [text]
            plan.append([self.special[s] if k % 2 else self.cut(s)
                         for k, s in enumerate(segments) if s])
        if len(self.pieces) > CACHE:
            self.pieces = {}
        have = self.pieces
        new: set[str] = set()
        for segments in plan:
            for s in segments:
                if not isinstance(s, int):
                    new.update(s)
        missing = [k for k in new if k not in have]
        got = dict(zip(missing, self._encode_pieces([self.piece(k) for k in missing])))
        have.update((k, v) for k, v in got.items() if len(k) <= CACHED_CHARS)
        long = {k: v for k, v in got.items() if len(k) > CACHED_CHARS}
        look = {**have, **long}.__getitem__ if long and len(have) < 2000 else (
            (lambda k: long[k] if k in long else have[k]) if long else have.__getitem__)
        out = []
        for segments in plan:
            parts = [s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(look, s))
                     for s in segments]
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; ids that no token has stand for nothing."""
        if ids and not 0 <= min(ids) <= max(ids) < len(self.bytes_of):
            ids = [i for i in ids if 0 <= i < len(self.bytes_of)]
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """The tokenizer of a file, once per Python worker."""
    return ByteBpe(path)


def _slices(texts: list, chars: int = 1 << 22) -> Iterator[list]:
    """Consecutive groups of about that many characters, so that what is held is bounded."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(text: Column, path: str) -> Column:
    """Array of token ids of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for array in column:
            got = [x for part in _slices(array.to_pylist()) for x in bpe.encode_batch(part)]
            ends = np.cumsum([0, *map(len, got)])
            flat = np.concatenate([np.empty(0, "<u4"), *got]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array column of token ids."""

    @F.arrow_udf(T.StringType())
    def text(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for array in column:
            yield pa.array([bpe.decode(x or []) for x in array.to_pylist()], pa.string())

    return text(ids)


def coded(text: Column, path: str) -> Column:
    """Struct of ``ids`` and ``decoded``: the token ids of a text and the text they decode to."""

    @F.arrow_udf(T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string"))
    def both(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for array in column:
            ids, back = [], []
            for part in _slices(array.to_pylist()):
                for found in bpe.encode_batch(part):
                    ids.append(found.astype(np.int32))
                    back.append(bpe.decode(found.tolist()))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                                             names=["ids", "decoded"])

    return both(text)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, digest of the decimal ids, digest of the text decoded from them."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for part in _slices(batch.column(1).to_pylist()):
                for found in bpe.encode_batch(part):
                    ids = found.tolist()
                    decimals = ",".join([bpe.decimal[i] for i in ids])
                    rows.append((len(ids), sha(decimals.encode()).hexdigest(),
                                 sha(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                 pa.array(b, pa.string())],
                names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType
    schema = (T.StructType().add(doc_id, kind).add("n_tokens", "long")
              .add("ids_sha256", "string").add("decoded_sha256", "string"))
    return docs.select(doc_id, text).mapInArrow(digests, schema)
