"""Custom-event reports over the raw events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from eventlens import schema
from eventlens.operators.filters import (
    between_days,
    consented,
    custom,
    event_day,
    named,
    of_game,
)

#: Dates that come to the driver at most.
MAX_DATES = 20_000


def name_counts(events: DataFrame, game: str, first: date, last: date) -> DataFrame:
    """Count, first and last occurrence and last arrival per custom event name."""
    rows = custom(consented(between_days(of_game(events, game), first, last)))
    return rows.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.max("received_at").alias("last_received_at"),
    )


def day_counts(events: DataFrame, name: str, game: str, first: date, last: date) -> DataFrame:
    """Count and last arrival per UTC date of one custom event."""
    rows = custom(named(consented(between_days(of_game(events, game), first, last)), name))
    return rows.groupBy(event_day(events).alias("metric_date")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("received_at").alias("last_received_at")
    )


def _newest_dates(events: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Rows of as many of the newest date partitions as hold ``limit`` rows.

    The range doubles until it is enough, so at most about twice the needed dates are read whole.
    The dates themselves come from the partitions, without any column of data. Beyond
    ``MAX_DATES`` of them nothing is cut.
    """
    found = events.filter("event_group = 'custom'").select("event_date").distinct().limit(MAX_DATES + 1).collect()
    if len(found) > MAX_DATES:
        return rows
    dates, n = sorted((r.event_date for r in found), reverse=True), 1
    while n < len(dates):
        near = rows.filter(F.col("event_date") >= F.lit(dates[n - 1]))
        if near.limit(limit).count() >= limit:
            return near
        n *= 2
    return rows


def recent(events: DataFrame, name: str, game: str, limit: int) -> DataFrame:
    """Newest events of one custom name, without any column that identifies a player.

    Of a table that is partitioned by date only the newest dates with enough events are read.
    """
    rows = custom(named(consented(of_game(events, game)), name))
    if {"event_date", "event_group"} <= set(rows.columns):
        rows = _newest_dates(events, rows, limit)
    ordered = rows.orderBy(F.desc("occurred_at"), F.asc("event_id")).limit(limit)
    return ordered.select(*[c for c in schema.RECENT_EVENT_COLUMNS if c in rows.columns])
