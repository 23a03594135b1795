"""The seven read entry points. Each returns one lazy DataFrame.

``public`` results hide figures of small groups, ``private`` results show them. ``as_of`` takes the
place of the current time, so every result can be reproduced.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventlens import fixed_values as fv
from eventlens.config import Settings
from eventlens.functions.privacy import mask
from eventlens.functions.scalars import ratio4
from eventlens.operators import custom_events, retention
from eventlens.operators.filters import last_days, of_game, utc
from eventlens.plans import params
from eventlens.sources.dimensions import calendar

DEFAULTS = Settings()


def _hidden(flag: str, visibility: str) -> Column:
    """True when any row of the group is flagged and the audience is public."""
    if params.visibility(visibility) == "private":
        return F.lit(False)
    return F.coalesce(F.bool_or(flag), F.lit(False))


def last_updated(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Earliest refresh among the rows that a metric was read from; ``as_of`` without rows."""
    return rows.agg(
        F.coalesce(F.min("last_refreshed_at"), F.lit(utc(as_of))).alias("last_updated")
    )


def last_received(rows: DataFrame, as_of: datetime, column: str = "received_at") -> DataFrame:
    """Latest arrival among the rows of a custom-event report; ``as_of`` without rows."""
    return rows.agg(F.coalesce(F.max(column), F.lit(utc(as_of))).alias("last_updated"))


def table_rows(table: DataFrame, first: date, last: date, game: str = "all") -> DataFrame:
    """Rows of a derived table between two dates, both included, in reading order."""
    day = "metric_date" if "metric_date" in table.columns else "cohort_date"
    rows = of_game(table, game).filter(F.col(day).between(F.lit(first), F.lit(last)))
    order = [F.col(day), F.col("game_id")]
    if "pick_count" in table.columns:
        category = next(c for c in table.columns if c.endswith("_id") and c != "game_id")
        order += [F.desc("pick_count"), F.col(category)]
    return rows.orderBy(*order)


def summary(
    table: DataFrame, game: str = "all", visibility: str = "public", settings: Settings = DEFAULTS
) -> DataFrame:
    """Current figures of one game, or summed over all games.

    The sum over games also applies to distinct players and to mean lengths, as dashboards expect;
    ``operators.daily.summary_pooled`` gives the pooled figures instead.
    """
    rows = of_game(table, params.game(game, settings.games))
    zero = F.lit(0).cast("bigint")
    figures = {
        "active_players": ("active_players_24h", "suppressed_active_players"),
        "avg_session_length_s": ("avg_session_length_s_24h", "suppressed_avg_session_length"),
        "matches_today": ("matches_today", "suppressed_matches_today"),
    }
    totals = rows.agg(
        *[F.coalesce(F.sum(value), zero).alias(name) for name, (value, _) in figures.items()],
        *[_hidden(flag, visibility).alias(f"{name}_hidden") for name, (_, flag) in figures.items()],
    )
    columns = [F.lit(game).alias("game_id")]
    for name in figures:
        hidden = F.col(f"{name}_hidden")
        columns.append(mask(hidden, F.col(name)).alias(name))
        columns.append(hidden.alias(f"{name}_suppressed"))
    return totals.select(*columns)


def sessions_points(
    table: DataFrame,
    as_of: datetime,
    game: str = "all",
    days: int = fv.SESSIONS_DAYS_DEFAULT,
    visibility: str = "public",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One point per day of the window, zero-filled; a day with any flagged game is hidden."""
    params.one_of("days", days, fv.SESSIONS_DAYS)
    first, last = last_days(as_of, days)
    rows = of_game(table, params.game(game, settings.games)).filter(
        F.col("metric_date").between(F.lit(first), F.lit(last))
    )
    names = ("session_count", "active_players", "avg_session_length_s")
    points = rows.groupBy("metric_date").agg(
        *[F.sum(name).alias(name) for name in names],
        _hidden("suppressed", visibility).alias("suppressed"),
    )
    dates = calendar(table.sparkSession, first, last).withColumnRenamed(
        "calendar_date", "metric_date"
    )
    hidden = F.coalesce("suppressed", F.lit(False))
    zero = F.lit(0).cast("bigint")
    return (
        dates.join(points, "metric_date", "left")
        .select(
            "metric_date",
            *[mask(hidden, F.coalesce(name, zero)).alias(name) for name in names],
            hidden.alias("suppressed"),
        )
        .orderBy("metric_date")
    )


def popularity(
    table: DataFrame,
    as_of: datetime,
    game: str = "all",
    days: int = fv.POPULARITY_DAYS_DEFAULT,
    visibility: str = "public",
    settings: Settings = DEFAULTS,
    key: str = "character_id",
) -> DataFrame:
    """Picks and share per category over the window, largest first.

    For the public, flagged rows of a day are merged into ``other``, whose count stays hidden and
    whose share is shown. ``is_other`` tells the merged row from a category of that name.
    """
    params.one_of("days", days, fv.POPULARITY_DAYS)
    public = params.visibility(visibility) == "public"
    first, last = last_days(as_of, days)
    rows = of_game(table, params.game(game, settings.games)).filter(
        F.col("metric_date").between(F.lit(first), F.lit(last))
    )
    merged = F.col("suppressed") if public else F.lit(False)
    label = F.when(merged, F.lit("other")).otherwise(F.col(key))
    picks = rows.groupBy(label.alias(key), merged.alias("is_other")).agg(
        F.sum("pick_count").alias("picks")
    )
    total = picks.agg(F.sum("picks")).scalar()
    return (
        picks.filter("picks > 0 or not is_other")
        .select(
            key,
            mask(F.col("is_other"), F.col("picks")).alias("pick_count"),
            ratio4(F.col("picks"), total).alias("pick_ratio"),
            F.col("is_other").alias("suppressed"),
        )
        .orderBy("suppressed", F.desc("pick_count"), key)
    )


def retention_cohorts(
    table: DataFrame,
    as_of: datetime,
    game: str = "all",
    weeks: int = fv.RETENTION_WEEKS_DEFAULT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Weekly retention, newest week first."""
    params.within("weeks", weeks, fv.RETENTION_WEEKS)
    params.game(game, settings.games)
    return retention.retention_weekly(table, game, weeks, settings.k, as_of)


def custom_names(
    events: DataFrame,
    as_of: datetime,
    game: str = "all",
    days: int = fv.CUSTOM_NAMES_DAYS_DEFAULT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Custom event names of the window, most frequent first."""
    params.within("days", days, fv.CUSTOM_DAYS)
    params.game(game, settings.games)
    counts = custom_events.name_counts(events, game, *last_days(as_of, days))
    return counts.drop("last_received_at").orderBy(F.desc("event_count"), "event_name")


def custom_counts(
    events: DataFrame,
    name: str,
    as_of: datetime,
    game: str = "all",
    days: int = fv.CUSTOM_COUNTS_DAYS_DEFAULT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Daily count of one custom event, zero-filled."""
    params.within("days", days, fv.CUSTOM_DAYS)
    params.game(game, settings.games)
    first, last = last_days(as_of, days)
    counts = custom_events.day_counts(events, params.custom_name(name), game, first, last)
    dates = calendar(events.sparkSession, first, last).withColumnRenamed(
        "calendar_date", "metric_date"
    )
    filled = dates.join(counts, "metric_date", "left")
    zero = F.lit(0).cast("bigint")
    return filled.select(
        "metric_date", F.coalesce("event_count", zero).alias("event_count")
    ).orderBy("metric_date")


def custom_recent(
    events: DataFrame,
    name: str,
    game: str = "all",
    limit: int = fv.RECENT_LIMIT_DEFAULT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Newest events of one custom name."""
    params.within("limit", limit, fv.RECENT_LIMIT)
    params.game(game, settings.games)
    return custom_events.recent(events, params.custom_name(name), game, limit)
