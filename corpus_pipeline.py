"""A corpus from raw documents to tokens: five stages, each written and read again by the next.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake.llm import bpe, linededup, mixing, rules, simhash
from brinelake.llm.common import importable, intermediates, stored, table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    importable(spark)
    return rules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of two lines or more, or of lines of ``linededup.LONG`` words or
    more, go; so does what is left without a word."""
    importable(spark)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return linededup.line_deduplicated(docs, instead={"n_chars": size})


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: fingerprints of three-word shingles
    within two bits."""
    importable(spark)
    return simhash.deduplicated(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    importable(spark)
    return mixing.mixture(docs)


def bpe_encoding_and_decoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to: doc_id, source, n_tokens, ids,
    decoded."""
    importable(spark)
    path = tokenizer_file("byte_bpe_50k.json")
    out = docs.select("doc_id", "source", F.inline(F.array(bpe.coded(F.col("text"), path))))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing to target weights", mixing_to_weights),
    ("BPE encoding and decoding", bpe_encoding_and_decoding),
]

#: SQL can express neither fingerprints nor merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back.

    What a stage writes on its way goes when its rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with intermediates(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
