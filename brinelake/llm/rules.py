"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger row keeps the measurements and one long in
which bit *k* says that rule *k* failed; a policy is a set of bits, so another policy, or the
same policy without one rule, needs no second look at the text: ``failures & mask``.

Defined cases: a null or blank text has zero for every measurement and fails the word count; a
repeated row gets a ledger row each; an empty table gives an empty ledger. ``filtered`` carries
columns under names of position, so that none can clash; ``ledger`` keeps them, and its own names
all begin with two underlines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.functions.barrier import with_once
from brinelake.llm.common import BLANKS, own_names, restored, words

#: Bit order of the ledger. Bits are never reused: a changed rule gets a new bit.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "exclamations")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_exclamations")

#: A policy is the set of rules that reject. Versions stay, so that old decisions can be redone.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": RULES,
}
CURRENT = "v2"


def _verdicts(m: Column) -> dict[str, Column]:
    """Rule -> true where a document with these measurements fails it."""
    return {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > 3 * m["n_words"],
        "repeated_lines": (m["n_dup_lines"] > 1) & (100 * m["n_dup_lines"] > 40 * m["n_lines"]),
        "exclamations": 10 * m["n_exclamations"] > 5 * m["n_words"],
    }


def bits(rules: Iterable[str]) -> int:
    return sum(1 << RULES.index(r) for r in set(rules))


def _kept_chars(text: Column, drop: str) -> Column:
    """Number of code points that ``drop``, a pattern, leaves."""
    return F.char_length(F.regexp_replace(text, drop, "")).cast("long")


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with one struct column ``into``: the measurements and ``failures``.

    A three-word window counts as repeated when its hash occurs twice in the text. Only
    documents with such a hash have their windows sorted; a window in sorted order beside an
    equal one is repeated, and the words covered are counted from the sorted positions, so a
    text of n words costs n log n whatever it repeats.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = with_once(docs, __words=words(F.col(text)), __lines=lines)
    df = with_once(df, __grams=F.expr(
        "CASE WHEN size(__words) < 3 THEN cast(array() AS array<bigint>) ELSE"
        " transform(sequence(0, size(__words) - 3),"
        "           i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) END"))
    df = with_once(df, __sorted=F.expr(
        "CASE WHEN size(array_distinct(__grams)) = size(__grams)"
        " THEN cast(array() AS array<struct<h: bigint, i: int>>)"
        " ELSE sort_array(transform(__grams, (h, i) -> struct(h, i))) END"))
    df = with_once(df, __at=F.expr(
        "sort_array(transform(filter(__sorted, (x, k) -> coalesce(x.h = get(__sorted, k - 1).h, false)"
        " OR coalesce(x.h = get(__sorted, k + 1).h, false)), x -> x.i))"))
    measured = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        _kept_chars(body, f"[{BLANKS}]+").alias("word_chars"),
        _kept_chars(body, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(__at, (p, k) -> least(3, coalesce(get(__at, k + 1) - p, 3))),"
               " 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        _kept_chars(body, r"[^!]+").alias("n_exclamations"),
    )
    df = with_once(df, __m=measured)
    fails = _verdicts(F.col("__m"))
    mask = sum((F.when(fails[r], F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
                for k, r in enumerate(RULES)), F.lit(0).cast("long"))
    return (df.withColumn(into, F.struct(*[F.col("__m")[m].alias(m) for m in MEASURES],
                                         mask.alias("failures")))
            .drop("__words", "__lines", "__grams", "__sorted", "__at", "__m"))


def passes(failures: Column, policy: str = CURRENT) -> Column:
    """True where no rule of the policy has failed."""
    return failures.bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0


def filtered(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns they came with."""
    inner, name = own_names(docs)
    book = ledger(inner, name[text], "ledger")
    return restored(book.where(passes(F.col("ledger.failures"), policy)), docs)


def ablations(book: DataFrame, policy: str = CURRENT, ledger_col: str = "ledger") -> DataFrame:
    """One row per rule of a policy: what it rejects, and what only it rejects.

    Rows: ``rule``, ``rejected`` (failures of the rule), ``only`` (documents that the policy
    without this rule would keep), ``kept_without`` (what that policy keeps in all). One
    aggregate over the ledger; the texts are not read.
    """
    mask = bits(POLICIES[policy])
    hit = F.col(f"{ledger_col}.failures").bitwiseAND(F.lit(mask))
    names = [r for r in RULES if r in POLICIES[policy]]
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    for r in names:
        sums += [F.count(F.when(hit.bitwiseAND(F.lit(bits([r]))) != 0, 1)).alias(f"rejected_{r}"),
                 F.count(F.when(hit == bits([r]), 1)).alias(f"only_{r}")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"rejected_{r}").alias("rejected"),
                              F.col(f"only_{r}").alias("only"),
                              (F.col("kept") + F.col(f"only_{r}")).alias("kept_without"))
                     for r in names])
    return book.agg(*sums).select(F.inline(rows))
