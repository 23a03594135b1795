"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The ASCII white space of the word and line rules, and the two cases of A-Z.
ASCII_SPACE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.

    Only a purely local session (one process, as in tests) may go without: it gets its own folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="eventlens-llm-")
        context.setCheckpointDir(folder)
    return folder or held.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: computed once, readable by every executor.

    The context's cleaner removes the files when nothing refers to the frame any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_digest(*columns: Column) -> Column:
    """128 bits that stand for a row in joins; null and the empty string differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\u0000", *parts)))


def free_name(taken, name: str) -> str:
    """``name``, with underscores in front as long as a column has it (case does not count)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


class clean_shuffles:
    """Shuffle files of the queries inside go when each query ends, not when the driver collects
    garbage. What the queries write (``cut``) stays, so nothing has to be computed again."""

    NAME = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, "true")

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.before)
