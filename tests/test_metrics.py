import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from eventlens import Settings
from eventlens.operators import daily, retention
from eventlens.plans import metrics
from eventlens.sources.dimensions import calendar, new_dates
from tests.factories import event, frame, rows, utc

GAMES = ("alpha", "beta")
AS_OF = utc("2026-04-05T12:00:00")


def test_sessions_daily_zero_fill_consent_and_flag(spark):
    events = [event("session_end", "2026-04-03T10:00:00", f"p{i}", duration_s=600) for i in range(10)]
    events += [event("session_end", "2026-04-05T10:00:00", f"p{i}", duration_s=600) for i in range(8)]
    events += [event("session_end", "2026-04-05T10:00:00", "x", consent=False, duration_s=600)]
    dates = calendar(spark, date(2026, 4, 3), date(2026, 4, 5))
    table = daily.sessions_daily(frame(spark, events), dates, GAMES, 10)
    alpha = table.filter("game_id = 'alpha'").orderBy("metric_date")
    assert rows(alpha, "active_players", "session_count", "suppressed") == [
        (10, 10, False),
        (0, 0, False),
        (8, 8, True),
    ]
    assert table.filter("game_id = 'beta' and session_count = 0 and not suppressed").count() == 3


def test_mean_length_rounds_half_away_and_ignores_missing(spark):
    events = [event("session_end", "2026-04-03T10:00:00", f"p{i}", duration_s=d) for i, d in enumerate((1, 2))]
    events += [event("session_end", "2026-04-03T10:00:00", "p3")]
    events += [event("session_end", "2026-04-04T10:00:00", "p3")]
    stats = daily.session_stats(frame(spark, events)).orderBy("metric_date")
    assert rows(stats, "session_count", "avg_session_length_s") == [(3, 2), (1, 0)]


def test_popularity_ratio_and_flag(spark):
    def pick(n, who, character, **kw):
        return [
            event("character_selected", "2026-04-05T10:00:00", f"{who}{i}", character_id=character, **kw)
            for i in range(n)
        ]

    events = pick(12, "w", "warden") + pick(4, "s", "shade") + pick(1, "o", "warden", consent=False)
    events += [event("character_selected", "2026-04-04T10:00:00", "u")]
    table = daily.category_popularity(frame(spark, events), 10).orderBy("metric_date", "pick_ratio")
    assert rows(table, "character_id", "pick_count", "pick_ratio", "suppressed") == [
        ("unknown", 1, 1.0, True),
        ("shade", 4, 0.25, True),
        ("warden", 12, 0.75, False),
    ]


def test_summary_window_and_empty_game(spark):
    events = [event("session_end", "2026-04-05T09:00:00", f"p{i}", duration_s=1800) for i in range(12)]
    events += [event("match_end", "2026-04-05T09:30:00", f"p{i}") for i in range(11)]
    events += [event("session_end", "2026-04-04T11:00:00", "old", duration_s=9)]
    events += [event("session_end", "2026-04-05T09:00:00", "out", consent=False, duration_s=9)]
    table = daily.summary_current(frame(spark, events), GAMES, 10, AS_OF).orderBy("game_id")
    assert rows(table) == [
        ("alpha", 12, 11, 1800, False, False, False),
        ("beta", 0, 0, 0, False, False, False),
    ]


def test_summary_keeps_future_events(spark):
    events = [event("session_end", "2026-04-05T13:00:00", "p", duration_s=5)]
    table = daily.summary_current(frame(spark, events), GAMES, 10, AS_OF)
    assert rows(table.filter("game_id = 'alpha'"), "active_players_24h") == [(1,)]


def test_summary_public_hides_all_when_one_game_is_flagged(spark):
    schema = (
        "game_id string, active_players_24h long, matches_today long, avg_session_length_s_24h long,"
        " suppressed_active_players boolean, suppressed_matches_today boolean,"
        " suppressed_avg_session_length boolean"
    )
    data = [("alpha", 12, 11, 900, False, False, False), ("beta", 8, 7, 600, True, True, True)]
    table = spark.createDataFrame(data, schema)
    names = ("active_players", "avg_session_length_s", "matches_today")
    assert rows(metrics.summary(table), *names) == [(None, None, None)]
    assert rows(metrics.summary(table, visibility="private"), *names) == [(20, 1500, 18)]
    assert rows(metrics.summary(table, game="alpha"), *names) == [(12, 900, 11)]
    assert rows(metrics.summary(table.limit(0)), *names) == [(0, 0, 0)]


def test_sessions_points_zero_fill_and_mask(spark):
    schema = (
        "metric_date date, game_id string, session_count long, active_players long,"
        " avg_session_length_s long, suppressed boolean"
    )
    data = [
        (date(2026, 4, 4), "alpha", 12, 10, 100, False),
        (date(2026, 4, 4), "beta", 11, 10, 50, False),
        (date(2026, 4, 5), "alpha", 12, 10, 100, False),
        (date(2026, 4, 5), "beta", 3, 3, 50, True),
    ]
    points = metrics.sessions_points(spark.createDataFrame(data, schema), AS_OF, days=7)
    result = rows(points, "session_count", "suppressed")
    assert len(result) == 7
    assert result[0] == (0, False)
    assert result[-2:] == [(23, False), (None, True)]


def test_popularity_merges_flagged_rows_into_other(spark):
    schema = (
        "metric_date date, game_id string, character_id string, pick_count long, pick_ratio double,"
        " suppressed boolean"
    )
    day = date(2026, 4, 5)
    data = [
        (day, "alpha", "warden", 12, 0.0, False),
        (day, "beta", "seer", 10, 0.0, False),
        (day, "beta", "shade", 7, 0.0, True),
    ]
    table = spark.createDataFrame(data, schema)
    assert rows(metrics.popularity(table, AS_OF)) == [
        ("warden", 12, 0.4138, False),
        ("seer", 10, 0.3448, False),
        ("other", None, 0.2414, True),
    ]
    private = metrics.popularity(table, AS_OF, visibility="private")
    assert rows(private, "character_id", "pick_count")[-1] == ("shade", 7)


def test_popularity_keeps_a_category_named_other_apart(spark):
    schema = (
        "metric_date date, game_id string, character_id string, pick_count long, pick_ratio double,"
        " suppressed boolean"
    )
    day = date(2026, 4, 5)
    data = [(day, "alpha", "other", 20, 0.0, False), (day, "alpha", "x", 5, 0.0, True)]
    table = spark.createDataFrame(data, schema)
    assert rows(metrics.popularity(table, AS_OF), "character_id", "pick_count") == [
        ("other", 20),
        ("other", None),
    ]


def test_retention_against_a_random_fold(spark):
    """Cohorts of random starts against sets of days per player."""
    rng = random.Random(17)
    first = date(2026, 2, 20)
    starts = [
        (rng.choice(("alpha", "beta")), f"p{rng.randrange(25)}", first + timedelta(days=rng.randrange(20)), rng.random() < 0.9)
        for _ in range(260)
    ]
    events = [
        event("session_start", f"{day}T{rng.randrange(24):02d}:30:00", player, game, consent=consent)
        for game, player, day, consent in starts
    ]
    days = defaultdict(set)
    for game, player, day, consent in starts:
        if consent:
            days[game, player].add(day)
    cohorts = defaultdict(lambda: [0, 0, 0])
    for (game, _), own in days.items():
        for k, gap in enumerate((0, 1, 7)):
            cohorts[min(own), game][k] += min(own) + timedelta(days=gap) in own
    expected = sorted(
        (day, game, n, d1, (20000 * d1 + n) // (2 * n) / 10000, 1 <= d1 < 3, d7, (20000 * d7 + n) // (2 * n) / 10000, 1 <= d7 < 3)
        for (day, game), (n, d1, d7) in cohorts.items()
    )
    names = (
        "cohort_date game_id cohort_size d1_retained d1_retention_pct d1_suppressed"
        " d7_retained d7_retention_pct d7_suppressed"
    ).split()
    assert sorted(rows(retention.retention_daily(frame(spark, events), 3), *names)) == expected


def test_retention_across_the_year_boundary(spark):
    events = [
        event("session_start", "2025-12-31T23:59:59", "p"),
        event("session_start", "2026-01-01T00:00:01", "p"),
        event("session_start", "2026-01-07T05:00:00", "p"),
    ]
    cohorts = retention.retention_daily(frame(spark, events), 10)
    assert rows(cohorts, "cohort_date", "d1_retained", "d7_retained") == [(date(2025, 12, 31), 1, 1)]


def test_weekly_retention(spark):
    schema = "cohort_date date, game_id string, cohort_size long, d1_retained long, d7_retained long"
    data = [
        (date(2026, 3, 17), "alpha", 12, 10, 8),
        (date(2026, 3, 16), "beta", 8, 7, 3),
        (date(2026, 3, 9), "beta", 5, 2, 0),
        (date(2025, 1, 1), "beta", 99, 99, 99),
    ]
    table = spark.createDataFrame(data, schema)
    weekly = metrics.retention_cohorts(table, utc("2026-03-22T12:00:00"))
    assert rows(weekly) == [
        (date(2026, 3, 16), 20, 17, 0.85, False, 11, 0.55, False),
        (date(2026, 3, 9), 5, None, 0.4, True, 0, 0.0, False),
    ]
    assert metrics.retention_cohorts(table, utc("2026-03-22T12:00:00"), weeks=1).count() == 1


def test_custom_event_reports(spark):
    events = [event("level_end", f"2026-04-05T1{i}:00:00", f"p{i}", level_id="a") for i in range(3)]
    events += [event("quest_started", "2026-04-05T11:00:00", "p1")]
    events += [event("level_end", "2026-04-05T11:00:00", "p2", consent=False)]
    events += [event("legacy_custom", "2026-04-05T11:00:00", "p2", version="1.0")]
    df = frame(spark, events)
    names = metrics.custom_names(df, AS_OF)
    assert rows(names, "event_name", "event_count") == [("level_end", 3), ("quest_started", 1)]
    counts = rows(metrics.custom_counts(df, "level_end", AS_OF), "event_count")
    assert len(counts) == 14 and counts[-1] == (3,) and counts[0] == (0,)
    recent = metrics.custom_recent(df, "level_end", limit=2)
    assert rows(recent, "occurred_at")[0][0].hour == 12
    assert recent.count() == 2
    assert not {"player_id_hash", "session_id", "api_key_id"} & set(recent.columns)
    assert metrics.custom_recent(df, "legacy_custom").count() == 0


def test_calendar_upsert_is_idempotent(spark):
    settings = Settings()
    dates = calendar(spark, settings.calendar_start, settings.calendar_end)
    assert dates.count() == 2557
    assert new_dates(dates, dates).count() == 0
    assert calendar(spark, date(2026, 4, 3), date(2026, 4, 5)).count() == 3


@pytest.mark.parametrize(
    "call",
    [
        lambda t: metrics.sessions_points(t, AS_OF, days=8),
        lambda t: metrics.sessions_points(t, AS_OF, game="gamma"),
        lambda t: metrics.popularity(t, AS_OF, days=30),
        lambda t: metrics.retention_cohorts(t, AS_OF, weeks=9),
        lambda t: metrics.custom_names(t, AS_OF, days=31),
        lambda t: metrics.custom_counts(t, "session_end", AS_OF),
        lambda t: metrics.custom_recent(t, "level_end", limit=0),
        lambda t: metrics.custom_recent(t, "Level", limit=1),
        lambda t: metrics.summary(t, visibility="secret"),
    ],
)
def test_parameters_outside_their_domain_fail(spark, call):
    with pytest.raises(ValueError):
        call(frame(spark, []))
