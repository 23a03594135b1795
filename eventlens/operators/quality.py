"""Data contract checks, opt-out purge and privacy checks on results."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from eventlens import fixed_values as fv
from eventlens import schema
from eventlens.functions.scalars import is_custom_name, utc_date, week_start
from eventlens.operators.filters import consented, named, utc


def counts_by_game(events: DataFrame) -> DataFrame:
    return events.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_custom_name(F.col("event_name"))).alias("custom_count"),
    )


def _check(name: str, value: Column, ok: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), value.cast("bigint").alias("value"), ok.alias("ok")
    )


def dataset_checks(events: DataFrame, games: tuple[str, ...], as_of: datetime) -> DataFrame:
    """Contract of a demo dataset as rows of (game_id, check, value, ok).

    Every configured game has all rows; one without events fails them. One aggregate per game gives
    the counts, one per player and one per game the weekly cohorts: weeks in which a player of the
    game has the first session. Volume ranges belong to the first and the second configured game.
    """
    fresh = F.col("occurred_at") >= F.lit(utc(as_of) - timedelta(minutes=15))
    shown = F.col("consent_analytics")
    ended = (F.col("event_name") == "session_end") & shown
    started = (F.col("event_name") == "session_start") & shown
    day = utc_date(F.col("occurred_at"))
    names = [F.count_if(F.col("event_name") == n).alias(n) for n in fv.CORE_EVENT_NAMES]
    own = events.filter(F.col("game_id").isin(*games))
    counts = own.groupBy("game_id").agg(
        *names,
        F.count(F.lit(1)).alias("events"),
        F.count_if(~shown).alias("consent_off"),
        F.count_if(fresh).alias("fresh"),
        F.size(F.collect_set(F.when(ended, day))).alias("session_days"),
    )
    firsts = own.filter(started).groupBy("game_id", "player_id_hash").agg(F.min(week_start(day)).alias("week"))
    cohorts = (
        firsts.groupBy("game_id", "week").agg(F.lit(1).alias("one"))
        .groupBy("game_id").agg(F.count(F.lit(1)).alias("weekly_cohorts"))
    )
    spine = events.sparkSession.createDataFrame([(g,) for g in games], "game_id string")
    joined = spine.join(counts, "game_id", "left").join(cohorts, "game_id", "left")
    totals = joined.select("game_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns[1:]])
    low, high = fv.CONSENT_OFF_PERCENT
    off, n = F.col("consent_off") * 100, F.col("events")
    checks = [
        ("consent_off_share", F.col("consent_off"), off.between(n * low, n * high) & (n > 0)),
        ("session_days", F.col("session_days"), F.col("session_days") >= 14),
        ("weekly_cohorts", F.col("weekly_cohorts"), F.col("weekly_cohorts") >= 8),
        ("fresh_events", F.col("fresh"), F.col("fresh") >= 1),
    ]
    for name in fv.CORE_EVENT_NAMES:
        in_range = F.lit(False)
        for game, ranges in zip(games, fv.VOLUME_CONTRACT):
            in_range = F.when(F.col("game_id") == game, F.col(name).between(*ranges[name])).otherwise(
                in_range
            )
        checks.append((f"volume_{name}", F.col(name), in_range))
    rows = F.array(*[_check(*check) for check in checks])
    return totals.select("game_id", F.inline(rows))


def bucket_checks(sessions: DataFrame, popularity: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Whether the derived tables show the public and the private suppression, as (check, value, ok).

    Days without sessions are no buckets.
    """
    hidden = F.count_if("suppressed").alias("hidden")
    shown = F.count_if(~F.col("suppressed")).alias("shown")
    buckets = (
        sessions.filter("session_count > 0")
        .select("suppressed")
        .unionByName(popularity.select("suppressed"))
        .agg(hidden, shown)
    )
    low = cohorts.agg(F.count_if(F.col("d7_retained") < 10).alias("low"))
    public = F.array(
        _check("suppressed_buckets", F.col("hidden"), F.col("hidden") >= 2),
        _check("visible_buckets", F.col("shown"), F.col("shown") >= 5),
    )
    private = F.array(_check("cohorts_below_10", F.col("low"), F.col("low") >= 1))
    return buckets.select(F.inline(public)).unionByName(low.select(F.inline(private)))


def bad_numbers(events: DataFrame, name: str, key: str) -> DataFrame:
    """Per game, how many values of a numeric property are missing or not a number."""
    text = F.get_json_object("props_json", f"$.{key}")
    rows = consented(named(events, name))
    return rows.groupBy("game_id").agg(
        F.count_if(text.isNull()).alias("missing"),
        F.count_if(text.isNotNull() & text.try_cast("decimal(20,6)").isNull()).alias("not_numeric"),
    )


def suppressed_share(points: DataFrame, *groups: str) -> DataFrame:
    """Points, hidden points and whether more than half are hidden, which is an empty state."""
    counts = points.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("points"), F.count_if("suppressed").alias("hidden")
    )
    return counts.withColumn("empty_state", F.col("hidden") * 2 > F.col("points"))


def purge_opted_out(events: DataFrame, opted_out: DataFrame, key: str = "player_id_hash") -> DataFrame:
    """Events without those of players that have opted out."""
    return events.join(opted_out.select(key), key, "left_anti")


def keep_recent(events: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Raw events inside the retention period."""
    return events.filter(F.col("occurred_at") >= F.lit(utc(as_of) - timedelta(days=days)))


def orphan_matches(events: DataFrame, match_id: Column) -> DataFrame:
    """``match_end`` events without an earlier ``match_start`` of the same match.

    The starts are reduced to the earliest one per match before the join, so the join adds no rows
    and a match with very many ends can be split between tasks.
    """
    ids = events.withColumn("_match", match_id)
    starts = (
        named(ids, "match_start").groupBy("_match").agg(F.min("occurred_at").alias("_started"))
    )
    ends = named(ids, "match_end").join(starts, "_match", "left")
    late = F.col("_started").isNull() | (F.col("_started") > F.col("occurred_at"))
    return ends.filter(late).select(*events.columns)


def leaked_identifiers(result: DataFrame) -> list[str]:
    """Columns of a result that identify a player, device or credential."""
    return sorted(set(result.columns) & set(schema.RAW_IDENTIFIERS))
