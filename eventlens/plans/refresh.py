"""Refresh jobs for the derived tables."""

from __future__ import annotations

import time
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventlens.config import Settings, use_utc
from eventlens.operators.daily import category_popularity, sessions_daily, summary_current
from eventlens.operators.filters import utc
from eventlens.operators.retention import active_days, cohorts_of_days
from eventlens.plans.ingest import seed
from eventlens.sources.dimensions import calendar, new_dates
from eventlens.sources.ledger import Ledger
from eventlens.sources.tables import days_of, exists, latest, prune_raw, publish, purge_players, read_events, remove, reset, staged, touched

ROLLING = ("sessions_daily", "character_popularity", "metrics_summary_current")
RETENTION = "retention_cohorts"
CALENDAR = "dim_dates"
PLAYER_DAYS = "player_days"
PLAYER_DAYS_SCHEMA = "game_id string, player_id_hash string, day date"


def _build(name: str, events: DataFrame, dates: DataFrame, settings: Settings, as_of: datetime):
    if name == "sessions_daily":
        return sessions_daily(events, dates, settings.games, settings.k)
    if name == "character_popularity":
        return category_popularity(events, settings.k)
    if name == "metrics_summary_current":
        return summary_current(events, settings.games, settings.k, as_of)
    raise ValueError(f"unsupported derived table: {name}")


def ensure_calendar(spark: SparkSession, tables: str, settings: Settings) -> int:
    """Add the missing calendar dates; returns how many were added."""
    path = f"{tables}/{CALENDAR}"
    wanted = calendar(spark, settings.calendar_start, settings.calendar_end)
    missing = new_dates(wanted, spark.read.parquet(path)) if exists(spark, path) else wanted
    added = missing.count()
    if added:
        missing.coalesce(1).write.mode("append").parquet(path)
    return added


def _player_days(spark: SparkSession, raw: str, tables: str, days: list | None, frozen: date | None) -> DataFrame:
    """Active days of all players, kept as a table by day; only the given days are made anew.

    Days before ``frozen``, whose raw events were deleted, stay as they are.
    """
    path = f"{tables}/{PLAYER_DAYS}"
    events = read_events(spark, raw)
    known = exists(spark, f"{path}/_SUCCESS")
    mode = "dynamic"
    if known and days is not None:
        for day in days:  # a day that has lost its last event gives no row
            remove(spark, f"{path}/day={day.isoformat()}")
        made = active_days(events.filter(F.col("event_date").isin(days)))
    elif known and frozen is not None:
        for day in days_of(spark, path, frozen):
            remove(spark, f"{path}/day={day}")
        made = active_days(events.filter(F.col("event_date") >= F.lit(frozen)))
    else:
        mode, made = "static", active_days(events)
    (
        made.distinct()
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("day")
        .parquet(path)
    )
    return spark.read.schema(PLAYER_DAYS_SCHEMA).parquet(path)


def refresh_table(
    spark: SparkSession,
    name: str,
    raw: str,
    tables: str,
    settings: Settings,
    as_of: datetime,
    days: list | None = None,
) -> str:
    """Recompute one derived table from the raw events and publish it.

    With ``days``, the dates of events that are new since the last refresh, only the rows of those
    dates are computed and the others are taken from the last snapshot. A retained cohort depends
    on all active days of its players; these are kept in a table of their own, of which only the
    given days are computed. The current summary reads two dates in any case.

    Dates before the horizon of ``prune_raw`` have no raw events any more. What was derived of them
    is history: with or without ``days`` their rows are taken over as they are, and late events of
    such dates change nothing. Only a table that was never published is made of what is there.
    """
    if name not in (*ROLLING, RETENTION):
        raise ValueError(f"unsupported derived table: {name}")
    use_utc(spark)
    events = read_events(spark, raw)
    dates = spark.read.parquet(f"{tables}/{CALENDAR}") if name == "sessions_daily" else None
    known = exists(spark, f"{tables}/{name}")
    frozen = Ledger(spark, raw).horizon()
    if days is not None and frozen is not None:
        days = [day for day in days if day >= frozen]
    if name == RETENTION:
        table = cohorts_of_days(_player_days(spark, raw, tables, days if known else None, frozen), settings.k)
    elif not known or name == "metrics_summary_current" or (days is None and frozen is None):
        table = _build(name, events, dates, settings, as_of)
    else:
        before = latest(spark, f"{tables}/{name}").drop("last_refreshed_at")

        def anew(day: Column) -> Column:
            return day >= F.lit(frozen) if days is None else day.isin(days)

        if dates is not None:
            have = before.select(F.col("metric_date").alias("calendar_date")).distinct()
            added = dates.join(have, "calendar_date", "left_anti")
            dates = dates.filter(anew(F.col("calendar_date"))).unionByName(added).distinct()
        made = _build(name, events.filter(anew(F.col("event_date"))), dates, settings, as_of)
        table = before.filter(~anew(F.col("metric_date"))).unionByName(made)
    stamped = table.withColumn("last_refreshed_at", F.lit(utc(as_of)))
    return publish(stamped, f"{tables}/{name}")


def _follow(spark: SparkSession, raw: str, follower: str, incremental: bool) -> tuple[list, list | None]:
    landings, days = touched(spark, raw, follower)
    return landings, days if incremental else None


def refresh_rolling(
    spark: SparkSession, raw: str, tables: str, settings: Settings, as_of: datetime, incremental: bool = False
) -> None:
    """Calendar, sessions, popularity and summary in this order; the first failure ends the job.

    An incremental run computes the dates of events that have landed since the last run, and a full
    run all dates; both give the same rows. The list of landings is cleared once all is published.
    """
    use_utc(spark)
    landings, days = _follow(spark, raw, "rolling", incremental)
    ensure_calendar(spark, tables, settings)
    for name in ROLLING:
        refresh_table(spark, name, raw, tables, settings, as_of, days)
    for path in landings:
        remove(spark, path)


def refresh_retention(
    spark: SparkSession, raw: str, tables: str, settings: Settings, as_of: datetime, incremental: bool = False
) -> int:
    """Make the retention cohorts anew; returns their number."""
    landings, days = _follow(spark, raw, "retention", incremental)
    refresh_table(spark, RETENTION, raw, tables, settings, as_of, days)
    for path in landings:
        remove(spark, path)
    return latest(spark, f"{tables}/{RETENTION}").count()


def purge(spark: SparkSession, raw: str, tables: str, opted_out: DataFrame) -> tuple[int, int]:
    """Delete opted-out players from the stored events and from the table of active days.

    Returns rewritten files of events and deleted events. The next refresh, of either mode, makes the
    dates of deleted events anew. Figures of dates before the horizon hold no player and stay, but
    for cohorts, which follow the active days.
    """
    counts = purge_players(spark, raw, opted_out)
    path = f"{tables}/{PLAYER_DAYS}"
    if exists(spark, path):
        days = spark.read.schema(PLAYER_DAYS_SCHEMA).parquet(path)
        players = opted_out.select("player_id_hash").distinct()
        held = [r.day for r in days.join(players, "player_id_hash", "left_semi").select("day").distinct().collect()]
        if held:  # dates of the calendar, so few
            kept = days.filter(F.col("day").isin(held)).join(players, "player_id_hash", "left_anti")
            with staged(kept, "purge-days") as rest:
                for day in held:
                    remove(spark, f"{path}/day={day.isoformat()}")
                rest.write.mode("append").partitionBy("day").parquet(path)
    return counts


COMMANDS = ("refresh:rolling", "refresh:retention", "refresh:all", "seed:demo", "prune:raw", "purge:players", "reset:raw")


def run_job(
    spark: SparkSession,
    command: str,
    raw: str,
    tables: str,
    settings: Settings,
    as_of: datetime | None = None,
    incremental: bool = False,
    events: DataFrame | None = None,
    days: int = 90,
    opted_out: DataFrame | None = None,
) -> DataFrame:
    """Run one of ``COMMANDS``; one report row.

    ``seed:demo`` appends prepared ``events`` and refreshes all, ``prune:raw`` deletes raw dates
    older than ``days``, ``purge:players`` deletes the players of ``opted_out`` and refreshes what
    has changed, ``reset:raw`` empties raw events and cohorts.
    """
    if command not in COMMANDS:
        raise ValueError(f"unknown command: {command}")
    if (command == "seed:demo" and events is None) or (command == "purge:players" and opted_out is None):
        raise ValueError(f"{command} needs a frame of {'events' if command == 'seed:demo' else 'players'}")
    started = time.monotonic()
    moment = as_of or datetime.now(timezone.utc)
    cohorts = generated = inserted = removed = None
    if command == "seed:demo":
        generated, inserted = events.count(), seed(events, raw)
    elif command == "prune:raw":
        removed = len(prune_raw(spark, raw, moment, days))
    elif command == "purge:players":
        removed = purge(spark, raw, tables, opted_out)[1]
    elif command == "reset:raw":
        empty = spark.createDataFrame([], latest(spark, f"{tables}/{RETENTION}").schema)
        reset(spark, raw, f"{tables}/{RETENTION}", empty)
    refreshes = command in ("seed:demo", "purge:players", "refresh:all")
    if refreshes or command == "refresh:rolling":
        refresh_rolling(spark, raw, tables, settings, moment, incremental or command == "purge:players")
    if refreshes or command == "refresh:retention":
        cohorts = refresh_retention(spark, raw, tables, settings, moment, incremental or command == "purge:players")
    duration = int((time.monotonic() - started) * 1000)
    return spark.createDataFrame(
        [(command, duration, utc(moment), "ok", cohorts, generated, inserted, removed)],
        "command string, duration_ms bigint, refreshed_at timestamp, status string,"
        " cohort_count bigint, generated_count bigint, inserted_count bigint, removed_count bigint",
    )


def table_report(spark: SparkSession, tables: str) -> DataFrame:
    """Rows and last refresh of every published table, as input of ``requests.refresh_lag``."""
    reports = [
        latest(spark, f"{tables}/{name}").agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.min("last_refreshed_at").alias("last_refreshed_at"),
        )
        for name in (*ROLLING, RETENTION)
        if exists(spark, f"{tables}/{name}")
    ]
    if not reports:
        raise FileNotFoundError(f"no published table under {tables}")
    return reduce(DataFrame.unionByName, reports)


def register_views(spark: SparkSession, tables: str) -> list[str]:
    """Register every published derived table as a temporary view for ``spark.sql``."""
    names = [n for n in (*ROLLING, RETENTION) if exists(spark, f"{tables}/{n}")]
    for name in names:
        latest(spark, f"{tables}/{name}").createOrReplaceTempView(name)
    if exists(spark, f"{tables}/{CALENDAR}"):
        spark.read.parquet(f"{tables}/{CALENDAR}").createOrReplaceTempView(CALENDAR)
        names.append(CALENDAR)
    return names
