"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that hold a word; blank lines are not compared and stay.
Of every two consecutive lines (a window) the one with the smaller hash, the later one if both are
equal, is a fingerprint, and so is every line of ``long`` words or more, which is a window of its
own. A passage of two lines or of one long line thus has a fingerprint at the same place of its
own wherever it stands: none is missed, and only fingerprints are written out.

Positions with one fingerprint come together, and a match is extended both ways: with the line
before, where the fingerprint is the least of those two, and with the line after. What two
positions share beyond that has fingerprints of its own, so matches grow to their full length
where they touch. A position whose extended match also starts earlier, in the order of (id,
place), is a later repeat, and its lines go; the first occurrence stays. Short single lines that
recur between differing lines stay.

No pairs of positions are formed: each looks up the first of its like, in a table that is written
first, so that the adaptive join can cut a line that stands in a third of all places. Lines are
equal if 128 bits of their SHA-256 are.

Defined cases: null text has no lines and stays null; a text of one short line is left alone;
lines are judged on the input, so a run that repeats inside one document loses the later copy;
rows with equal ids are ordered by their place in the file, null ids come last; an empty table
gives an empty table. The columns of the table are carried under names of position and cannot
clash with names used here; only the two counts are added beside them, under names to be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.functions.barrier import with_once
from brinelake.llm.common import BLANKS, own_names, restored, row_keyed, written

#: Words that make a line a passage of its own.
LONG = 50
_KEY = ["__file", "__row"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _long(line: Column, words: int) -> Column:
    """Whether a line has so many words."""
    return (F.char_length(line) >= 2 * words - 1) & line.rlike(
        f"^[{BLANKS}]*+(?:[^{BLANKS}]++[{BLANKS}]++){{{words - 1}}}[^{BLANKS}]")


def fingerprints(rows: DataFrame, doc_id: str, text: str, long: int = LONG) -> DataFrame:
    """One row per fingerprint: its document, the line ``at``, its digest ``f``, and what it is to
    be extended with: ``sides``, each a digest (null for a long line alone) and its line."""
    df = rows.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"),
                              *_KEY).alias("doc"), F.col(text).alias("t"))
    spoken = F.filter(F.transform(_lines(F.col("t")), lambda x, k: F.struct(
        k.alias("k"), F.when(x.rlike(f"[^{BLANKS}]"), F.substring(F.unhex(F.sha2(x, 256)), 1, 16)).alias("h"),
        _long(x, long).alias("long"))), lambda x: x["h"].isNotNull())
    df = with_once(df.where(F.col("t").isNotNull()), spoken=spoken).drop("t")
    found = F.expr("""
        filter(transform(spoken, (x, i) -> struct(x.k AS at, x.h AS f, filter(array(
            struct(0 AS side, if(x.h <= get(spoken, i - 1).h, get(spoken, i - 1).h, NULL) AS other, get(spoken, i - 1).k AS line),
            struct(1 AS side, if(x.h < get(spoken, i + 1).h, get(spoken, i + 1).h, NULL) AS other, get(spoken, i + 1).k AS line),
            struct(2 AS side, if(x.long, x.h, NULL) AS other, x.k AS line)), s -> s.other IS NOT NULL) AS sides)),
          p -> size(p.sides) > 0)""")
    return df.select("doc", F.inline(found))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """The rows with their file keys, and per row with repeats the line numbers that go."""
    rows = row_keyed(docs)
    places = written(fingerprints(rows, doc_id, text, long), "line-prints")
    shared = written(places.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("f"),
                     "line-shared")
    match = ["side", "f", "other"]
    met = places.join(shared, "f").select("doc", "at", "f", F.inline("sides"))
    met = written(met, "line-matches")
    first = written(met.groupBy(*match).agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
                    .where(F.col("n") > 1).drop("n"), "line-firsts")
    later = met.join(first, match).where(F.struct("doc", "at") > F.col("first"))
    gone = (later.groupBy(*[F.col(f"doc.{k}").alias(k) for k in _KEY])
            .agg(F.array_distinct(F.flatten(F.collect_list(F.array("at", "line")))).alias("__gone")))
    return rows, gone


def line_deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", emptied: bool = False,
                      long: int = LONG, counts: tuple[str, str] | None = None,
                      instead: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with their texts less the later repeated runs.

    A document left without a word by this is a copy of earlier text; it goes unless ``emptied``.
    ``counts`` names two columns to add, lines and removed lines.  ``instead`` has values, made of
    ``text`` (the new one), for columns that change with a text that changes.
    """
    inner, name = own_names(docs)
    body = name[text]
    rows, gone = repeats(inner, name[doc_id], body, long)
    df = with_once(rows.join(gone, _KEY, "left"), __cut=_lines(F.col(body)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), F.col("__gone"))
    df = with_once(df, text=F.when(F.col("__gone").isNull(), F.col(body)).otherwise(
        F.array_join(F.transform(stay, lambda k: F.get(F.col("__cut"), k)), "\n")))
    if not emptied:
        df = df.where(F.col("__gone").isNull() | F.col("text").rlike(f"[^{BLANKS}]"))
    more = [] if counts is None else [F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias(counts[0]),
                                      F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(counts[1])]
    new = {c: F.when(F.col("__gone").isNull(), F.col(name[c])).otherwise(v) for c, v in (instead or {}).items()}
    return restored(df, docs, *more, **{text: F.col("text"), **new})
