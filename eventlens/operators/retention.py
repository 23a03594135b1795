"""Retention cohorts by first session day, and their weekly roll-up."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.privacy import mask
from eventlens.functions.scalars import ratio4, week_start
from eventlens.operators.filters import consented, event_day, named, of_game, utc


def active_days(events: DataFrame) -> DataFrame:
    """``game_id, player_id_hash, day`` of every session start, with repeats."""
    day = event_day(events).alias("day")
    return consented(named(events, "session_start")).select("game_id", "player_id_hash", day)


def cohort_members(days: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    """First session date per game and player, with one flag per day offset, from active days.

    Each player is reduced to the set of active dates, combined before the shuffle. The set is
    bounded by the number of calendar days, however many events a player has.
    """
    per_player = days.groupBy("game_id", "player_id_hash").agg(F.collect_set("day").alias("dates"))
    first = F.array_min("dates")
    flags = [
        F.array_contains("dates", F.date_add(first, days)).alias(f"d{days}") for days in offsets
    ]
    return per_player.select("game_id", first.alias("cohort_date"), *flags)


def retention_daily(
    events: DataFrame, k: int, offsets: tuple[int, ...] = (1, 7), as_of: date | None = None
) -> DataFrame:
    """Cohort size and exact-day returns per cohort date and game.

    With ``as_of``, a ``dN_mature`` column tells whether day N has passed.
    """
    return cohorts_of_days(active_days(events), k, offsets, as_of)


def cohorts_of_days(
    days: DataFrame, k: int, offsets: tuple[int, ...] = (1, 7), as_of: date | None = None
) -> DataFrame:
    """``retention_daily`` from active days, with or without repeats."""
    members = cohort_members(days, offsets)
    size = F.count(F.lit(1)).alias("cohort_size")
    returns = [F.count_if(f"d{n}").alias(f"d{n}_retained") for n in offsets]
    cohorts = members.groupBy("cohort_date", "game_id").agg(size, *returns)
    derived = []
    for n in offsets:
        kept = F.col(f"d{n}_retained")
        derived.append(ratio4(kept, F.col("cohort_size")).alias(f"d{n}_retention_pct"))
        derived.append(((kept > 0) & (kept < k)).alias(f"d{n}_suppressed"))
        if as_of is not None:
            mature = F.date_add("cohort_date", n) < F.lit(as_of)
            derived.append(mature.alias(f"d{n}_mature"))
    return cohorts.select("*", *derived)


def retention_weekly(
    daily: DataFrame, game: str, weeks: int, k: int, as_of: datetime
) -> DataFrame:
    """Cohorts per Monday week, newest first, for the last ``weeks`` weeks up to ``as_of``.

    The flags are derived again from the weekly sums, and a flagged count is hidden while its
    percentage stays visible.
    """
    last_day = utc(as_of).date()
    end_week = last_day - timedelta(days=last_day.weekday())
    start_week = end_week - timedelta(weeks=weeks - 1)
    in_range = F.col("cohort_date").between(F.lit(start_week), F.lit(last_day))
    weekly = (
        of_game(daily, game)
        .filter(in_range)
        .groupBy(week_start(F.col("cohort_date")).alias("cohort_date"))
        .agg(
            F.sum("cohort_size").alias("cohort_size"),
            F.sum("d1_retained").alias("d1"),
            F.sum("d7_retained").alias("d7"),
        )
    )
    hidden = {n: (F.col(n) > 0) & (F.col(n) < k) for n in ("d1", "d7")}
    columns = ["cohort_date", "cohort_size"]
    for n in ("d1", "d7"):
        columns += [
            mask(hidden[n], F.col(n)).alias(f"{n}_retained"),
            ratio4(F.col(n), F.col("cohort_size")).alias(f"{n}_retention_pct"),
            hidden[n].alias(f"{n}_suppressed"),
        ]
    return weekly.select(*columns).orderBy(F.desc("cohort_date")).limit(weeks)
