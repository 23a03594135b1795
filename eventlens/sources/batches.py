"""Readers for request files and for persisted offline events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from eventlens import schema

UNREADABLE = "_unreadable"
WITH_TEXT = T.StructType([*schema.REQUESTS.fields, T.StructField(UNREADABLE, T.StringType())])
TEXT_OPTION = ("columnNameOfCorruptRecord", UNREADABLE)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Landed requests as JSON lines, one request per line, with the untouched body as text.

    A line that is no JSON object is kept whole as the body, marked as ``unreadable`` and named by
    its file and text, so that it is reported and not lost.
    """
    return marked_requests(spark.read.schema(WITH_TEXT).option(*TEXT_OPTION).json(path))


def marked_requests(read: DataFrame) -> DataFrame:
    """Requests from rows of ``WITH_TEXT``, read with ``TEXT_OPTION``."""
    text = F.col(UNREADABLE)
    named = F.sha2(F.concat_ws("\n", F.col("_metadata.file_path"), text), 256)
    return read.select(
        F.coalesce("batch_id", F.concat(F.lit("unreadable-"), named)).alias("batch_id"),
        "api_key_id",
        "received_at",
        F.coalesce("body", text).alias("body"),
        text.isNotNull().alias("unreadable"),
    )


def read_bodies(spark: SparkSession, path: str, api_key_id: str) -> DataFrame:
    """Bare request bodies of one credential, one ``{"events": [...]}`` object per line.

    The file's time stands for the arrival. A request is judged by its own row alone, so the id only
    has to name it in reports.
    """
    lines = spark.read.text(path).select("value", "_metadata")
    source = F.col("_metadata.file_path")
    return lines.filter(F.trim("value") != "").select(
        F.sha2(F.concat_ws("\n", source, "value"), 256).alias("batch_id"),
        F.lit(api_key_id).alias("api_key_id"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    )


def read_offline_events(spark: SparkSession, path: str) -> DataFrame:
    """Events persisted by a client, one JSON object per line. Other lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    parsed = lines.select("line", F.try_parse_json("line").alias("event"))
    kind = F.schema_of_variant("event")
    return parsed.filter((F.col("line") != "") & kind.startswith("OBJECT"))
