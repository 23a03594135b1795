"""The seven read results with the columns that every response carries.

To the rows of ``metrics`` come ``game_id``, the window (``days`` or ``weeks``, where there is one)
and ``last_updated``: the earliest refresh among the rows of a derived table that were read, or the
latest arrival among the custom events. The figure is a scalar subquery over the same rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from eventlens import fixed_values as fv
from eventlens.config import Settings
from eventlens.operators import custom_events
from eventlens.operators.filters import last_days, of_game, utc
from eventlens.plans import metrics

DEFAULTS = Settings()


def _framed(points: DataFrame, updated: DataFrame, game: str, **window: int) -> DataFrame:
    """Add the columns; a result that has the game of each row keeps it."""
    constants = {name: F.lit(value) for name, value in window.items()}
    if "game_id" not in points.columns:
        constants["game_id"] = F.lit(game)
    return points.withColumns({**constants, "last_updated": updated.scalar()})


def _between(table: DataFrame, day: str, first, last, game: str) -> DataFrame:
    return of_game(table, game).filter(F.col(day).between(F.lit(first), F.lit(last)))


def summary(table, as_of: datetime, game="all", visibility="public", settings=DEFAULTS) -> DataFrame:
    points = metrics.summary(table, game, visibility, settings)
    return _framed(points, metrics.last_updated(of_game(table, game), as_of), game)


def sessions(
    table, as_of: datetime, game="all", days=fv.SESSIONS_DAYS_DEFAULT, visibility="public", settings=DEFAULTS
) -> DataFrame:
    points = metrics.sessions_points(table, as_of, game, days, visibility, settings)
    rows = _between(table, "metric_date", *last_days(as_of, days), game)
    return _framed(points, metrics.last_updated(rows, as_of), game, days=days)


def popularity(
    table, as_of: datetime, game="all", days=fv.POPULARITY_DAYS_DEFAULT, visibility="public", settings=DEFAULTS
) -> DataFrame:
    points = metrics.popularity(table, as_of, game, days, visibility, settings)
    rows = _between(table, "metric_date", *last_days(as_of, days), game)
    return _framed(points, metrics.last_updated(rows, as_of), game, days=days)


def retention(
    table, as_of: datetime, game="all", weeks=fv.RETENTION_WEEKS_DEFAULT, settings=DEFAULTS
) -> DataFrame:
    points = metrics.retention_cohorts(table, as_of, game, weeks, settings)
    last = utc(as_of).date()
    first = last - timedelta(days=last.weekday()) - timedelta(weeks=weeks - 1)
    rows = _between(table, "cohort_date", first, last, game)
    return _framed(points, metrics.last_updated(rows, as_of), game, weeks=weeks)


def custom_names(
    events, as_of: datetime, game="all", days=fv.CUSTOM_NAMES_DAYS_DEFAULT, settings=DEFAULTS
) -> DataFrame:
    points = metrics.custom_names(events, as_of, game, days, settings)
    counts = custom_events.name_counts(events, game, *last_days(as_of, days))
    return _framed(points, metrics.last_received(counts, as_of, "last_received_at"), game, days=days)


def custom_counts(
    events, name: str, as_of: datetime, game="all", days=fv.CUSTOM_COUNTS_DAYS_DEFAULT, settings=DEFAULTS
) -> DataFrame:
    points = metrics.custom_counts(events, name, as_of, game, days, settings)
    counts = custom_events.day_counts(events, name, game, *last_days(as_of, days))
    return _framed(points, metrics.last_received(counts, as_of, "last_received_at"), game, days=days)


def custom_recent(
    events, name: str, as_of: datetime, game="all", limit=fv.RECENT_LIMIT_DEFAULT, settings=DEFAULTS
) -> DataFrame:
    points = metrics.custom_recent(events, name, game, limit, settings)
    return _framed(points, metrics.last_received(points, as_of), game)
