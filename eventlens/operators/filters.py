"""Shared event filters. Game and name predicates are only added when they are asked for, so that
they reach the scan as plain comparisons."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from eventlens import fixed_values as fv
from eventlens.functions.scalars import is_core_name, utc_date


def utc(instant: datetime) -> datetime:
    """The instant in UTC; a value without a zone is taken as UTC."""
    if instant.tzinfo is None:
        return instant.replace(tzinfo=timezone.utc)
    return instant.astimezone(timezone.utc)


def event_day(events: DataFrame) -> Column:
    """UTC date of the events; the partition column where there is one, so that filters on the
    date prune partitions."""
    return F.col("event_date") if "event_date" in events.columns else utc_date(F.col("occurred_at"))


def consented(events: DataFrame) -> DataFrame:
    return events.filter(F.col("consent_analytics"))


def named(events: DataFrame, *names: str) -> DataFrame:
    """Events of the given names; prunes partitions where the table has event groups."""
    if "event_group" in events.columns:
        groups = {name if name in fv.CORE_EVENT_NAMES else "custom" for name in names}
        events = events.filter(F.col("event_group").isin(*sorted(groups)))
    return events.filter(F.col("event_name").isin(*names))


def custom(events: DataFrame) -> DataFrame:
    """Custom events that keep the contract: their own schema version and no core name."""
    if "event_group" in events.columns:
        events = events.filter(F.col("event_group") == "custom")
    return events.filter(
        (F.col("schema_version") == fv.CUSTOM_SCHEMA_VERSION) & ~is_core_name(F.col("event_name"))
    )


def of_game(df: DataFrame, game: str) -> DataFrame:
    return df if game == "all" else df.filter(F.col("game_id") == game)


def from_instant(events: DataFrame, start: datetime) -> DataFrame:
    """Events from an instant on, with no upper bound; prunes date partitions."""
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date") >= F.lit(start.date()))
    return events.filter(F.col("occurred_at") >= F.lit(start))


def between_days(events: DataFrame, first: date, last: date) -> DataFrame:
    """Events of whole UTC days from first to last, as a half-open range of instants."""
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date").between(F.lit(first), F.lit(last)))
    start = F.lit(first).cast("timestamp")
    end = F.lit(last + timedelta(days=1)).cast("timestamp")
    return events.filter((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))


def last_days(as_of: datetime, days: int) -> tuple[date, date]:
    """First and last date of a window of ``days`` days that ends on the date of ``as_of``."""
    last = utc(as_of).date()
    return last - timedelta(days=days - 1), last
