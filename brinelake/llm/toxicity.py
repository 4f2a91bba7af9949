"""Toxicity of texts after noisy-channel deobfuscation.

A word written to hide itself (``1d10t``, ``i d i o t``, ``iiidiooot``) is seen as a plain word
sent through a channel that swaps letters for look-alikes, puts separators between letters and
repeats letters. Its characters form a lattice of readings with costs; a character trigram model
says how likely letters follow each other; the Viterbi path is the restored word. The trigram
counts come from every document. The restored words and their beginnings are then weighed by the
log odds that labelled documents give them, and a logistic curve turns a document's sum into a
score.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id, of the
two folds that are given for it: the weights come from both, the curve from sums of each fold
under weights of the other. Its other bounds: a weight needs ``LEAST_POSITIVE`` toxic rows and log
odds of ``LEAST_ODDS``, counts as ``MOST_ODDS`` at most, and is one of at most ``FEATURES``; the curve
sees sums over ``MOST_SUM`` as that. Counts of characters have no bound, and every whole text is
scored.

Defined cases: null and empty texts get the score of a text without a weighed word; several
labels of one id count as toxic if one does; labels without a document and null labels are not
used; without usable labels every score is 0. Repeated rows score alike. Rows are independent;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT_ROWS = 40_000
FEATURES = 20_000
LEAST_POSITIVE = 5
LEAST_ODDS = 3.0
MOST_ODDS, MOST_SUM = 10.0, 100.0
CACHE = 400_000

# Look-alikes of letters, as people write them.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
SEPARATORS = " .-_*~'/"
SWAP_COST, SKIP_COST, REPEAT_COST = 1.0, 0.5, 0.5

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_N = 64
_INDEX = {c: k + 1 for k, c in enumerate(_LETTERS)}
_TABLE = np.array([_INDEX.get(chr(b), 0) for b in range(256)], np.int64)
_APART = re.compile(r"[^\W_]|[@$!|+]")
_SPACED_RUN = re.compile(rf"(?<!\S)(?:(?:{_APART.pattern})[ .\-_*]++){{2,}}(?:{_APART.pattern})(?!\w)")
_EDGE = re.compile(r"^[^\w@$|+]+|(?:[^\w$]+|[^\w]{2,})$")
_OUTER = re.compile("^[^\\w{0}]+|[^\\w{0}]+$".format(re.escape("".join(LOOKALIKES))))
_PLAIN = re.compile(r"[^\W\d_]+")
_AGAIN = re.compile(r"([^\W\d_])\1\1")


def _slices(texts: list, chars: int = 1 << 22) -> Iterator[list]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) over the letters and one mark for everything else, from all texts.

    Each task sends one number per trigram it has seen; at most 64**3 come to the driver.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N ** 3, np.int64)
        for batch in batches:
            for part in _slices([t or "" for t in batch.column(0).to_pylist()]):
                raw = " ".join(["", *part, ""]).lower().encode("latin-1", "replace")
                x = _TABLE[np.frombuffer(raw, np.uint8)]
                if len(x) > 2:
                    total += np.bincount((x[:-2] * _N + x[1:-1]) * _N + x[2:], minlength=_N ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = (docs.select(text).mapInArrow(count, "at long, n long").groupBy("at")
            .agg(F.sum("n").alias("n")).collect())
    n = np.zeros(_N ** 3)
    for r in rows:
        n[r["at"]] = r["n"]
    n = n.reshape(_N, _N, _N)
    one = (n.sum((0, 1)) + 1) / (n.sum() + _N)
    two = (n.sum(0) + 20 * one) / (n.sum(0).sum(1, keepdims=True) + 20)
    three = (n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20)
    return np.log(three)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a lower-case token, with their channel costs."""
    places: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(token):
        c = token[k]
        run = 1
        while k + run < len(token) and token[k + run] == c:
            run += 1
        if c in _INDEX or c in LOOKALIKES:
            options = [(c, 0.0)] if c in _INDEX else [(x, SWAP_COST) for x in LOOKALIKES[c]]
            if run > 1:  # a long run is one letter or two
                base = [(x, cost + REPEAT_COST * (run > 2)) for x, cost in options]
                options = base + [(x + x, cost) for x, cost in base]
                if run == 2 and c in _INDEX:
                    options = [(c + c, 0.0), (c, 2 * REPEAT_COST)]
            if not c.isalnum() and c not in "@$":
                options = [*options, ("", SKIP_COST + SWAP_COST)]
            places.append(options)
        else:
            places.append([("", SKIP_COST if c in SEPARATORS else SKIP_COST + SWAP_COST)])
        k += run
    return places


def viterbi(places: list[list[tuple[str, float]]], model: list) -> str:
    """The likeliest word of a lattice: letters' trigram log probability less channel costs."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in places:  # a blank among the readings is the end of a word
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, word) in best.items():
            for letters, cost in options:
                q, x, y = p - cost, a, b
                for c in letters:
                    z = _INDEX.get(c, 0)
                    q += model[x][y][z]
                    x, y = y, z
                if (x, y) not in new or q > new[x, y][0]:
                    new[x, y] = (q, word + letters)
        best = new
    return max((p + model[a][b][0], word) for (a, b), (p, word) in best.items())[1]


def _parts(places: list, length: int = 96, shared: int = 32) -> Iterator[list]:
    """Parts that overlap, so that a word of ``shared`` letters is whole in one of them."""
    for k in range(0, max(1, len(places) - shared), length - shared):
        yield places[k:k + length]


class Restorer:
    """Restored words of tokens and texts under one character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def word(self, token: str) -> str:
        """The plain word of one token; lower case, without punctuation around it."""
        core = _EDGE.sub("", token).lower()
        if not core or (_PLAIN.fullmatch(core) and not _AGAIN.search(core)):
            return core
        if not any(c in _INDEX for c in core):
            return core
        places = lattice(core)
        return viterbi(places, self.model) if len(places) <= 64 else core

    def second(self, token: str) -> str | None:
        """The word with the look-alikes around it read as letters, as in ``!diot`` and ``(lown``."""
        core = _OUTER.sub("", token).lower()
        if core == _EDGE.sub("", token).lower() or not any(c in _INDEX for c in core):
            return None
        places = lattice(core)
        return viterbi(places, self.model) if len(places) <= 64 else None

    def long(self, token: str) -> tuple[list[str], list[str]]:
        """Of a token that stays long when repeated letters are folded: its decoded parts, and
        these cut into words. Other tokens have none."""
        core = _OUTER.sub("", token).lower()
        if len(core) <= 64 or _PLAIN.fullmatch(core) and not _AGAIN.search(core) or not any(c in _INDEX for c in core):
            return [], []
        places = lattice(core)
        return self._both(places) if len(places) > 64 else ([], [])

    def _both(self, places: list) -> tuple[list[str], list[str]]:
        strings, words = [], []
        for part in _parts(places):
            strings.append(viterbi(part, self.model))
            cut = [p + [(" ", p[0][1])] if p[0][0] == "" else p for p in part]
            words += viterbi(cut, self.model).split()
        return strings, words

    def apart(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """Letters that stand apart, as in ``i d i o t``, per run: decoded parts, and their words."""
        for m in _SPACED_RUN.finditer(text):
            run = _APART.findall(m[0].lower())
            if any(c in _INDEX for c in run):
                blank = [("", SKIP_COST)]
                places = [p for c in run for p in (*lattice(c), blank)][:-1]
                yield self._both(places)

    def spaced(self, text: str) -> list[str]:
        """The decoded strings of letters that stand apart; a long run is read in parts."""
        return [w for strings, _ in self.apart(text) for w in strings]


def _features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in (4, 5, 6, 7, 8) if len(word) > k]]


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Weigher:
    """Sum of the evidence of the distinct words of a text: squared log odds, over ten.

    Squares, since a word seen in many toxic rows and no other tells more than two seen in a few.
    """

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        self.restorer, self.weights = restorer, weights
        self.longest = max(map(len, weights), default=0)
        self.memory: dict[str, tuple[tuple[str, float], ...]] = {}

    def _of(self, word: str | None) -> tuple[str, float] | None:
        best = max((self.weights.get(f, 0.0) for f in _features(word)), default=0.0) if word else 0.0
        return (word, best) if best > 0 else None

    def _inside(self, text: str, least: int) -> dict[str, float]:
        """Words and beginnings of ``least`` letters or more at every place; of those that
        overlap the one that tells most."""
        found = []
        for a in range(len(text) - least + 1):
            for b in range(a + least, min(len(text), a + self.longest) + 1):
                part = text[a:b]
                best = max(self.weights.get(part, 0.0), self.weights.get(part + "*", 0.0) if b < len(text) else 0.0)
                if best > 0:
                    found.append((-best, a - b, a, b))
        hits, taken = {}, set()
        for w, _, a, b in sorted(found):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                hits[text[a:b]] = -w
        return hits

    def _hidden(self, strings: list[str], words: list[str], least: int) -> dict[str, float]:
        """What is found in decoded strings; their words are for what is shorter than ``least``."""
        hits: dict[str, float] = {}
        for w in strings:
            hits |= self._inside(w, least)
        for h in map(self._of, words):
            if h is not None and not any(k in h[0] for k in hits):
                hits[h[0]] = h[1]
        return hits

    def _token(self, token: str) -> tuple[tuple[str, float], ...]:
        known = [h for h in (self._of(self.restorer.word(token)), self._of(self.restorer.second(token))) if h]
        if len(token) > 64 and (parts := self.restorer.long(token))[0]:
            # chance has words of four letters in any long code, so these need the cut into words
            return tuple(self._hidden(*parts, 5).items())
        return (max(known, key=lambda h: h[1]),) if known else ()

    def total(self, text: str | None) -> float:
        if not text:
            return 0.0
        if len(self.memory) > CACHE:
            self.memory = {}
        memory = self.memory
        tokens = set(text.split())
        for t in tokens:
            if t not in memory:
                memory[t] = self._token(t)
        hits = {w: x for t in tokens for w, x in memory[t]}
        for strings, words in self.restorer.apart(text):
            for w, x in self._hidden(strings, words, 4).items():
                hits[w] = max(x, hits.get(w, 0.0))
        return sum(w * w for w in hits.values()) / 10


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, folds: list[int],
              bound: int) -> DataFrame:
    """(text, toxic, fold) of at most about ``bound`` labelled rows, chosen by a hash of the id."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()
                          & _fold(F.col(doc_id)).isin(folds))
             .groupBy(F.col(doc_id).alias("__id")).agg(F.max("toxic").alias("toxic")))
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return (docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), "__id")  # bounded by ``bound``
            .select("text", "toxic", _fold(F.col("__id")).alias("fold")))


def _weights(rows: dict[str, tuple[int, int]], texts: tuple[int, int]) -> dict[str, float]:
    """Log odds of the features that clearly speak for toxic, from (toxic, other) rows with each."""
    pos, neg = texts
    odds = {w: float(np.log((p + 0.5) / (pos + 1) * (neg + 1) / (n + 0.5)))
            for w, (p, n) in rows.items() if w not in ("", "*") and p >= LEAST_POSITIVE}
    clear = ((w, min(x, MOST_ODDS)) for w, x in odds.items() if x >= LEAST_ODDS)
    return dict(sorted(clear, key=lambda r: (-r[1], r[0]))[:FEATURES])


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text",
        folds: tuple[int, int] = (0, 2), bound: int = FIT_ROWS) -> tuple[dict[str, float], float, float]:
    """Weights of words and beginnings, then slope and offset of the logistic curve.

    The weights come from both folds. The curve has to see sums of texts that the weights do not
    come from: those of each fold under the weights of the other.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    known = _labelled(docs, labels, doc_id, text, list(folds), bound)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        memory: dict[str, list[str]] = {}
        for batch in batches:
            seen = tuple(Counter() for _ in range(4))
            for t, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found = {""}
                for token in set((t or "").split()):
                    if token not in memory:
                        if len(memory) > CACHE:
                            memory.clear()
                        memory[token] = _features(restorer.word(token))
                    found.update(memory[token])
                seen[2 * (fold == folds[1]) + (toxic > 0)].update(found)
            names = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([c[w] for w in names], pa.int64()) for c in seen]],
                names=["feature", "n0", "p0", "n1", "p1"])

    counts = (known.mapInArrow(count, "feature string, n0 long, p0 long, n1 long, p1 long").groupBy("feature")
              .agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")]))
    pos, neg = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    top = counts.where(pos >= LEAST_POSITIVE).orderBy(pos.desc(), "feature").limit(20 * FEATURES + 1)
    rows = {r["feature"]: r for r in top.where((F.col("feature") == "") | (pos > neg)).collect()}
    if "" not in rows:
        return {}, 0.0, -30.0
    one, other, both = (
        _weights({w: (sum(r[c] for c in p), sum(r[c] for c in n)) for w, r in rows.items()},
                 (sum(rows[""][c] for c in p), sum(rows[""][c] for c in n)))
        for p, n in ((("p0",), ("n0",)), (("p1",), ("n1",)), (("p0", "p1"), ("n0", "n1"))))
    told = spark.sparkContext.broadcast((one, other))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_one, by_other = (Weigher(Restorer(sent.value), w) for w in told.value)
        for batch in batches:
            texts, _, fold = (c.to_pylist() for c in batch.columns)
            found = [int(10 * min(MOST_SUM, (by_one if f == folds[1] else by_other).total(t))) for t, f in zip(texts, fold)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(1).cast(pa.int64())],
                                             names=["s", "toxic"])

    bins = (known.mapInArrow(sums, "s long, toxic long")
            .groupBy("s").agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("t"))
            .orderBy("s").collect())
    return both, *_curve([(r["s"], r["n"], r["t"]) for r in bins])


def _curve(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and offset of P(toxic) over log(1 + sum), by damped Newton steps on smoothed counts.

    Bins are tenths of a sum, rows, toxic rows.
    """
    bins = [*bins, (0, 1, 0), (80, 1, 1)]  # one pseudo-count on either side
    x = np.array([np.log1p(b[0] / 10) for b in bins])
    n, t = (np.array([b[k] for b in bins], float) for k in (1, 2))
    design, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(design @ w)))
        grad = design.T @ (t - n * p) - 1e-2 * w
        hess = (design.T * (n * p * (1 - p))) @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           folds: tuple[int, int] = (0, 2), bound: int = FIT_ROWS) -> DataFrame:
    """Per row: the id, ``total`` (sum of evidence) and ``score``."""
    model = character_model(docs, text)
    weights, slope, offset = fit(docs, labels, model, doc_id, text, folds, bound)
    context = docs.sparkSession.sparkContext
    sent, told = context.broadcast(model), context.broadcast(weights)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(Restorer(sent.value), told.value)
        for batch in batches:
            total = np.array([weigher.total(t) for t in batch.column(1).to_pylist()], float)
            got = 1 / (1 + np.exp(-(slope * np.log1p(total) + offset)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(got)],
                                             names=[batch.schema.names[0], "total", "score"])

    schema = T.StructType().add(doc_id, docs.schema[doc_id].dataType).add("total", "double").add("score", "double")
    return docs.select(doc_id, text).mapInArrow(score, schema)
