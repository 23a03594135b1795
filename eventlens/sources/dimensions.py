"""Calendar and games dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F


def _one_row(spark: SparkSession) -> DataFrame:
    """One row in one partition, so that a dimension needs no exchange to be sorted."""
    return spark.range(0, 1, 1, 1)


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every date from start to end, both included."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    return _one_row(spark).select(F.explode(days).alias("calendar_date"))


def games(spark: SparkSession, game_ids: tuple[str, ...]) -> DataFrame:
    ids = F.array(*[F.lit(game) for game in game_ids])
    return _one_row(spark).select(F.explode(ids).alias("game_id"))


def spine(dates: DataFrame, game_ids: tuple[str, ...]) -> DataFrame:
    """One row per date and game. The games are a literal list, so no join is needed."""
    ids = F.array(*[F.lit(game) for game in game_ids])
    return dates.select(F.col("calendar_date").alias("metric_date"), F.explode(ids).alias("game_id"))


def new_dates(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Dates to add for an idempotent calendar upsert; empty on the second run."""
    return wanted.join(existing.select("calendar_date"), "calendar_date", "left_anti")
