"""Derived tables: daily sessions, category popularity and the current summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from eventlens.functions.privacy import small_group
from eventlens.functions.scalars import count_text
from eventlens.operators.filters import consented, event_day, from_instant, named, utc
from eventlens.sources.dimensions import games as games_frame, spine


def _rounded_mean(total, count):
    """Integer mean of a decimal sum, halves away from zero; 0 when no row carried a value.

    Integral division keeps it exact: a quotient cut to some scale would be rounded twice.
    """
    magnitude = F.call_function("div", F.abs(total) * 2 + count, count * 2)
    mean = F.when(total < 0, -magnitude).otherwise(magnitude)
    return F.coalesce(F.when(count > 0, mean), F.lit(0)).cast("bigint")


def player_sessions(events: DataFrame) -> DataFrame:
    """Sessions and sums of lengths per UTC date, game and player."""
    length = count_text(F.col("props_json"), "duration_s")
    return (
        consented(named(events, "session_end"))
        .groupBy(event_day(events).alias("metric_date"), "game_id", "player_id_hash")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum(length).alias("length_sum"),
            F.count(length).alias("length_count"),
        )
    )


def session_figures(sums: DataFrame) -> DataFrame:
    """Figures per date and game from their ``sessions``, ``players`` and sums of lengths."""
    return sums.select(
        "metric_date",
        "game_id",
        F.col("sessions").alias("session_count"),
        F.col("players").alias("active_players"),
        _rounded_mean(F.col("length_sum"), F.col("length_count")).alias("avg_session_length_s"),
    )


def session_stats(events: DataFrame) -> DataFrame:
    """Sessions, distinct players and mean length per UTC date and game.

    Rows are first combined per player, so the distinct count is a plain count afterwards and one
    dominant game is spread over its players.
    """
    sums = player_sessions(events).groupBy("metric_date", "game_id").agg(
        F.sum("sessions").alias("sessions"),
        F.count("player_id_hash").alias("players"),
        F.sum("length_sum").alias("length_sum"),
        F.sum("length_count").alias("length_count"),
    )
    return session_figures(sums)


def sessions_daily(
    events: DataFrame, dates: DataFrame, games: tuple[str, ...], k: int
) -> DataFrame:
    """Session statistics for every calendar date and game, zero-filled, with the group flag."""
    stats = session_stats(events).filter(F.col("game_id").isin(*games))
    filled = spine(dates, games).join(stats, ["metric_date", "game_id"], "left")
    zero = F.lit(0).cast("bigint")
    return filled.select(
        "metric_date",
        "game_id",
        F.coalesce("session_count", zero).alias("session_count"),
        F.coalesce("active_players", zero).alias("active_players"),
        F.coalesce("avg_session_length_s", zero).alias("avg_session_length_s"),
        small_group(F.col("active_players"), k).alias("suppressed"),
    )


def category_popularity(
    events: DataFrame, k: int, name: str = "character_selected", key: str = "character_id"
) -> DataFrame:
    """Picks per date, game and category with their share of the day's picks.

    The share is a window sum over the already aggregated rows; the events are shuffled once per
    player and once per category, and never joined to their own totals.
    """
    category = F.coalesce(F.get_json_object("props_json", f"$.{key}"), F.lit("unknown"))
    per_player = (
        consented(named(events, name))
        .groupBy(
            event_day(events).alias("metric_date"),
            "game_id",
            category.alias(key),
            "player_id_hash",
        )
        .agg(F.count(F.lit(1)).alias("picks"))
    )
    totals = per_player.groupBy("metric_date", "game_id", key).agg(
        F.sum("picks").alias("pick_count"), F.count("player_id_hash").alias("players")
    )
    day = Window.partitionBy("metric_date", "game_id")
    share = F.col("pick_count").cast("double") / F.sum("pick_count").over(day).cast("double")
    return totals.select(
        "metric_date",
        "game_id",
        key,
        "pick_count",
        share.alias("pick_ratio"),
        small_group(F.col("players"), k).alias("suppressed"),
    )


def summary_stats(events: DataFrame, as_of: datetime) -> DataFrame:
    """Per-game figures of the last 24 hours and of the current UTC day, in one scan.

    Events after ``as_of`` count, because the window has no upper bound.
    """
    day_ago = utc(as_of) - timedelta(hours=24)
    midnight = utc(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    recent = F.col("occurred_at") >= F.lit(day_ago)
    ended = (F.col("event_name") == "session_end") & recent
    match = (F.col("event_name") == "match_end") & (
        event_day(events) == F.lit(midnight.date())
    )
    length = F.when(ended, count_text(F.col("props_json"), "duration_s"))
    rows = consented(named(from_instant(events, min(day_ago, midnight)), "session_end", "match_end"))
    per_player = rows.groupBy("game_id", "player_id_hash").agg(
        F.count_if(ended).alias("sessions"),
        F.count_if(match).alias("matches"),
        F.sum(length).alias("length_sum"),
        F.count(length).alias("length_count"),
    )
    return per_player.groupBy("game_id").agg(
        F.count_if(F.col("sessions") > 0).alias("active_players_24h"),
        F.sum("matches").alias("matches_today"),
        F.count_if(F.col("matches") > 0).alias("match_players"),
        F.sum("length_sum").alias("length_sum"),
        F.sum("length_count").alias("length_count"),
    )


def summary_current(
    events: DataFrame, games: tuple[str, ...], k: int, as_of: datetime
) -> DataFrame:
    """Current summary, one row per configured game also without events."""
    stats = summary_stats(events, as_of).filter(F.col("game_id").isin(*games))
    filled = games_frame(events.sparkSession, games).join(stats, "game_id", "left")
    zero = F.lit(0).cast("bigint")
    players = small_group(F.col("active_players_24h"), k)
    return filled.select(
        "game_id",
        F.coalesce("active_players_24h", zero).alias("active_players_24h"),
        F.coalesce("matches_today", zero).alias("matches_today"),
        _rounded_mean(F.col("length_sum"), F.col("length_count")).alias("avg_session_length_s_24h"),
        players.alias("suppressed_active_players"),
        small_group(F.col("match_players"), k).alias("suppressed_matches_today"),
        players.alias("suppressed_avg_session_length"),
    )


def summary_pooled(
    events: DataFrame, games: tuple[str, ...], k: int, as_of: datetime
) -> DataFrame:
    """Summary over all games as one population: players counted once per game, weighted mean."""
    stats = summary_stats(events, as_of).filter(F.col("game_id").isin(*games))
    total = stats.agg(
        F.sum("active_players_24h").alias("players"),
        F.sum("matches_today").alias("matches"),
        F.sum("match_players").alias("match_players"),
        F.sum("length_sum").alias("length_sum"),
        F.sum("length_count").alias("length_count"),
    )
    zero = F.lit(0).cast("bigint")
    return total.select(
        F.lit("all").alias("game_id"),
        F.coalesce("players", zero).alias("active_players_24h"),
        F.coalesce("matches", zero).alias("matches_today"),
        _rounded_mean(F.col("length_sum"), F.col("length_count")).alias("avg_session_length_s_24h"),
        small_group(F.col("players"), k).alias("suppressed_active_players"),
        small_group(F.col("match_players"), k).alias("suppressed_matches_today"),
    )
