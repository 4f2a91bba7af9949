"""What the operators share: table reading, written intermediates, words."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake.session import fresh_folder

#: White space of the word rule, as a character class body: space, tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def importable(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it.

    Clusters install the package or get it by their own means; this serves sessions that were
    started elsewhere on a machine with the same folders.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders of the open ``intermediates`` blocks, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the folder stays."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, as an intermediate.

    This cuts the lineage: what follows is planned on known sizes, is computed once however
    often it is used, and a lost executor costs only a new read of the file. Inside a block of
    ``intermediates`` the folder goes when the block ends.
    """
    out = stored(df, label)
    if _open:
        _open[-1] += sorted({os.path.dirname(f) for f in out.inputFiles()})
    return out


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of intermediates that nothing reads any more."""
    for path in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """A block whose intermediates are deleted at its end, whether it ends well or not.

    What is computed inside has to be ``stored`` inside: a frame that is still to be computed
    would not find its inputs any more.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        dropped(spark, made)


def words(text: Column) -> Column:
    """Array of the runs of characters other than the six ASCII blanks; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by position, and the new name of each old one.

    Whatever a table calls its columns, they cannot clash with names that an operator adds.
    """
    new = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new))


def restored(df: DataFrame, docs: DataFrame, *more: Column, **instead: Column) -> DataFrame:
    """The columns of ``docs`` in a frame that descends from ``own_names(docs)``, then ``more``;
    ``instead`` has new values for some of them, by their old names."""
    return df.select(*[instead.get(n, F.col(f"c{k}")).alias(n) for k, n in enumerate(docs.columns)], *more)


def row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, which name a row whatever its values repeat.

    They come from the file that the row is read from, so they are the same in every pass and
    under every split. A frame that does not come straight from files is written first; one that
    repeats rows of a file by a generator has to be written by the caller.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64("_metadata.file_path").alias("__file"),
                         F.col("_metadata.row_index").alias("__row"))

    try:
        return keyed(docs)
    except AnalysisException:
        return keyed(written(docs, "rows"))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, as its package gives it on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, after which Spark deletes shuffle files of steps
    whose result is written. Without it they may stay until the query ends."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
