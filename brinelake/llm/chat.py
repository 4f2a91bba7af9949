"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, once, with the character spans of its trained turns; the text is
encoded once, with the offsets of its tokens; sorted turn spans and token spans are intersected by
binary search. A token is under the mask if it shares a character with a trained span, and the
spans say which of its characters count, so a token that reaches over an edge takes nothing from
beyond it.

Template: ``<turn>role`` line end ``text</turn>`` line end. Inside roles and texts a backslash is
doubled and the ``<`` of a control string becomes ``\\l``; line ends in roles become ``\\n``. The
control strings therefore never occur inside, and reading back is exact.

Defined cases: rows of a conversation are ordered by turn, then role, then text, nulls first; a
null role or text is empty; repeated rows are turns of their own; a null conversation id is a
conversation; a conversation without a trained role has an empty mask. A conversation is one unit
and is rendered in one task; other columns are not looked at.

A task holds about ``CHARS`` characters of rendered text with their tokens at a time, or one
conversation, whatever the number of rows that it gets at once; numbers stay in flat arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS = 1 << 18
OPEN, CLOSE = "<turn>", "</turn>"
TRAINED = ("assistant",)
_ESCAPE = re.compile(r"\\|<(?=/?turn>)")
_BACK = re.compile(r"\\(.)", re.S)
_CODE = {"\\": "\\\\", "<": "\\l"}
_PLAIN = {"\\": "\\", "l": "<", "n": "\n"}
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def escaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODE[m[0]], text)


def plain(text: str) -> str:
    return _BACK.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]], trained: Iterable[str] = TRAINED) -> tuple[str, list[int], list[int]]:
    """Formatted text, and the starts and ends of the trained texts in it."""
    parts, starts, ends, n = [], [], [], 0
    for role, text in turns:
        head = f"{OPEN}{escaped(role)}".replace("\n", "\\n") + "\n"
        body = escaped(text)
        if role in trained:
            starts.append(n + len(head))
            ends.append(n + len(head) + len(body))
        parts += [head, body, CLOSE + "\n"]
        n += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), starts, ends


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    out = []
    for piece in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = piece[len(OPEN):].partition("\n")
        out.append((plain(role), plain(text)))
    return out


def mask(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens, given as rows (start, end), share a character with a span. Spans are sorted;
    empty ones hold no character."""
    full = ends > starts
    starts, ends = starts[full], ends[full]
    if not len(starts) or not len(tokens):
        return np.zeros(len(tokens), bool)
    first = np.searchsorted(ends, tokens[:, 0], "right")  # the first span that ends after the token starts
    return ((first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < tokens[:, 1])
            & (tokens[:, 0] < tokens[:, 1]))


def trained_text(formatted: str, tokens: np.ndarray, under: np.ndarray, starts: list[int],
                 ends: list[int]) -> str:
    """The characters of the masked tokens inside the spans, unescaped, each once and in order."""
    cover = np.bincount(tokens[under, 0], minlength=len(formatted) + 1)
    cover -= np.bincount(tokens[under, 1], minlength=len(formatted) + 1)
    lit = np.cumsum(cover, out=cover) > 0
    return "".join([plain("".join([formatted[k] for k in np.flatnonzero(lit[s:e]) + s])
                          if not lit[s:e].all() else formatted[s:e]) for s, e in zip(starts, ends)])


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # names of special tokens in a text are text
    return t


@lru_cache(maxsize=2)
def _cuttable(path: str) -> bool:
    """Whether no token crosses ``_CUT``: plain byte-level words, as they stand."""
    from tokenizers import pre_tokenizers

    t = _library(path)
    words = t.pre_tokenizer
    return (t.normalizer is None and isinstance(words, pre_tokenizers.ByteLevel) and words.use_regex
            and not words.add_prefix_space)


def parts(text: str, chars: int = CHARS) -> Iterator[tuple[int, str]]:
    """Consecutive parts of a text, of about that many characters, and where they start. Cuts are
    before single blanks and line ends between other characters; without one the part goes on."""
    at = 0
    while len(text) - at > chars and (cut := _CUT.search(text, at + chars)):
        yield at, text[at:cut.start()]
        at = cut.start()
    yield at, text[at:]


def encoded(text: str, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text, and a row (start, end) for each."""
    library = _library(tokenizer)
    ids, spans = [], []
    for at, part in parts(text) if _cuttable(tokenizer) else [(0, text)]:
        coded = library.encode(part, add_special_tokens=False)
        ids.append(np.array(coded.ids, np.int32))
        spans.append(np.fromiter(chain.from_iterable(coded.offsets), np.int32, 2 * len(coded)) + np.int32(at))
    return np.concatenate(ids), np.concatenate(spans).reshape(-1, 2)


def _lists(arrays: Iterable, kind: type) -> pa.ListArray:
    flat = [np.asarray(x, kind) for x in arrays]
    ends = np.cumsum([0, *map(len, flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(np.concatenate([np.empty(0, kind), *flat])))


def _each(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column, as places of its one flat array."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))


_OUT = ("formatted string, ids array<int>, token_starts array<int>, token_ends array<int>,"
        " loss array<boolean>, span_starts array<int>, span_ends array<int>")


def formatted(rows: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Per conversation: the text, its ids with offsets, the mask per token, the trained spans."""
    names = [f.split()[0] for f in _OUT.split(", ")]

    def together(keys: pa.Array, held: list[tuple], name: str) -> pa.RecordBatch:
        whole, ids, spans, under, starts, ends = zip(*held)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(whole, pa.string()), _lists(ids, np.int32), _lists([x[:, 0] for x in spans], np.int32),
             _lists([x[:, 1] for x in spans], np.int32), _lists(under, np.bool_), _lists(starts, np.int32),
             _lists(ends, np.int32)], names=[name, *names])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars, first, name = [], 0, 0, batch.schema.names[0]
            for k, turns in enumerate(batch.column(1)):
                whole, starts, ends = render([(t["role"], t["text"]) for t in turns.as_py()], trained)
                ids, spans = encoded(whole, tokenizer)
                under = mask(spans, np.array(starts, np.int64), np.array(ends, np.int64))
                held.append((whole, ids, spans, under, starts, ends))
                chars += len(whole)
                if chars >= CHARS or k + 1 == batch.num_rows:
                    yield together(batch.column(0)[first:k + 1], held, name)
                    held, chars, first = [], 0, k + 1

    turn_of = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                       F.coalesce(text, F.lit("")).alias("text"))
    grouped = rows.groupBy(conv_id).agg(F.sort_array(F.collect_list(turn_of)).alias("turns"))
    kind = rows.schema[conv_id].dataType.simpleString()
    return grouped.mapInArrow(build, f"{conv_id} {kind}, {_OUT}")


def read_back(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per formatted conversation what its text and its mask hold, as counts and digests."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, a, b, loss, starts, ends in zip(batch.column(1), *map(_each, batch.columns[2:])):
                whole = text.as_py()
                turns = turns_of(whole)
                told = "".join([f"{r}\n{t}\n" for r, t in turns])
                kept = trained_text(whole, np.stack([a, b], 1), loss, starts.tolist(), ends.tolist())
                for held, x in zip(out, (len(turns), hashlib.sha256(told.encode()).hexdigest(),
                                         len(kept), hashlib.sha256(kept.encode()).hexdigest(), len(whole))):
                    held.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]],
                names=[batch.schema.names[0], *names])

    schema = (T.StructType().add(conv_id, chats.schema[conv_id].dataType).add("n_turns", "long")
              .add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string")
              .add("formatted_chars", "long"))
    return chats.select(conv_id, "formatted", "token_starts", "token_ends", "loss", "span_starts",
                        "span_ends").mapInArrow(digest, schema)
