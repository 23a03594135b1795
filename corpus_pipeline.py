"""The corpus pipeline: five stages from raw documents to a shuffled training mixture.

Each stage reads the whole table that the one before has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.llm import decontaminate, lines, mixing, simhash, toxicity
from eventlens.llm.common import shared_folder, table
from eventlens.llm.queries import MIX_EPOCHS, MIX_WEIGHTS

#: Near duplicates: words of a shingle, and differing bits of the 64-bit fingerprints up to which two
#: documents link.
SHINGLE = 3
RADIUS = 3
TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``TOXIC``; it learns from all that have a label.

    Null and empty texts are scored like any other; repeated rows share a verdict.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored, name = toxicity.score(docs, model)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a null text stays null."""
    return lines.dedupe_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    Documents link if their SimHash fingerprints differ in ``RADIUS`` bits at most. Null and empty
    texts link like any other, ties of ids fall by text, and repeated rows leave one.
    """
    groups = simhash.near_duplicates(docs, width=SHINGLE, radius=RADIUS)
    return simhash.keep_one(docs, groups)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; a document that is mostly such passages goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents at the target shares of their sources, in random order."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_EPOCHS)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmarks),
    ("mixing", mix_sources),
]

#: A learned classifier and fingerprints by XXH64 have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents. What a stage keeps is written to the shared folder and removed
    when the next stage is written; the last such table stays for the result, which reads it."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
