"""Ordered operators against plain folds over random rows, with one key that holds a third."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventlens.operators import dedupe, replay, requests, sessions
from eventlens.operators.sliced import SLICE, in_ranges
from tests.factories import rows, utc

START = datetime(2026, 4, 1, tzinfo=timezone.utc)
EVENTS = "event_id string, player string, event_name string, occurred_at timestamp, body string"


def random_events(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        player = "hot" if rng.random() < 0.34 else f"p{rng.randrange(40)}"
        # Whole minutes give many equal times and gaps of exactly 30 minutes.
        at = START + timedelta(minutes=rng.randrange(0, 3 * 24 * 60, 5))
        name = rng.choice(["session_start", "click", "click", "click"])
        out.append((f"e{i:04d}", player, name, at, "é" * rng.randrange(0, 9)))
    return out


def by_player(events):
    groups = {}
    for e in sorted(events, key=lambda e: (e[3], e[0])):
        groups.setdefault(e[1], []).append(e)
    return groups


@pytest.mark.parametrize("start_event, ranges", [("session_start", 7), (None, 7), ("session_start", None)])
def test_sessionize_equals_a_fold(spark, start_event, ranges):
    events = random_events(1)
    expected = {}
    for group in by_player(events).values():
        number, last = 0, None
        for e in group:
            idle = last is None or (e[3] - last) >= timedelta(minutes=30)
            if idle or e[2] == start_event:
                number += 1
            expected[e[0]], last = number, e[3]
    numbered = sessions.sessionize(
        spark.createDataFrame(events, EVENTS), key="player", start_event=start_event, ranges=ranges
    )
    assert dict(rows(numbered, "event_id", "session_no")) == expected


def test_a_hot_key_is_spread_over_ranges(spark):
    """All events of one key in one hour: ranges have about the same size."""
    at = [START + timedelta(seconds=i % 3600) for i in range(4000)]
    df = spark.createDataFrame([(f"e{i:05d}", "hot", "click", t, "") for i, t in enumerate(at)], EVENTS)
    placed = in_ranges(df, ["player"], [F.col("occurred_at"), F.col("event_id")], 8)
    sizes = [n for _, n in rows(placed.groupBy(SLICE).count())]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_events_exactly_thirty_minutes_apart_are_two_sessions(spark):
    data = [
        ("a", "p", "click", START, ""),
        ("b", "p", "click", START + timedelta(minutes=30), ""),
        ("c", "p", "click", START + timedelta(minutes=59, seconds=59), ""),
    ]
    numbered = sessions.sessionize(spark.createDataFrame(data, EVENTS), key="player")
    assert sorted(rows(numbered, "event_id", "session_no")) == [("a", 1), ("b", 2), ("c", 2)]
    durations = sessions.session_durations(numbered, key="player").orderBy("session_no")
    assert rows(durations, "event_count", "duration_s") == [(1, 0), (2, 1799)]


@pytest.mark.parametrize("max_rows, max_bytes", [(25, 10**9), (10**6, 200), (15, 120), (0, 10)])
def test_tail_budget_equals_dropping_the_oldest(spark, max_rows, max_bytes):
    events = random_events(2)
    expected = set()
    for group in by_player(events).values():
        kept = list(group)
        while len(kept) > max_rows:
            kept.pop(0)
        while kept and sum(len(e[4].encode()) + 1 for e in kept) > max_bytes:
            kept.pop(0)
        expected |= {e[0] for e in kept}
    kept = sessions.tail_budget(
        spark.createDataFrame(events, EVENTS), "player", "body", max_rows=max_rows, max_bytes=max_bytes, ranges=6
    )
    assert {r[0] for r in rows(kept, "event_id")} == expected


def test_pack_batches_equals_slicing(spark):
    events = random_events(3)
    expected = {}
    for group in by_player(events).values():
        for i, e in enumerate(group):
            expected[e[0]] = (i // 10, i % 10)
    packed = sessions.pack_batches(spark.createDataFrame(events, EVENTS), "player", ranges=9)
    assert {r[0]: r[1:] for r in rows(packed, "event_id", "batch_no", "position")} == expected


def test_dedupe_keeps_the_first_arrival(spark):
    rng = random.Random(4)
    data = []
    for i in range(500):
        event_id = "hot" if i % 3 == 0 else f"e{rng.randrange(60)}"
        data.append((event_id, START + timedelta(seconds=rng.randrange(50)), i))
    df = spark.createDataFrame(data, "event_id string, received_at timestamp, n int")
    expected = {}
    for event_id, at, n in data:
        expected[event_id] = min(expected.get(event_id, (at, n)), (at, n))
    first = dedupe.first_per_event(df)
    assert {r[0]: (r[1].replace(tzinfo=timezone.utc), r[2]) for r in rows(first)} == expected
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_dedupe_prefers_the_earlier_position_of_a_batch(spark):
    at = START
    data = [("e", at, "b1", 1, "a"), ("e", at, "b1", 0, "z"), ("e", at, "b2", 0, "a")]
    df = spark.createDataFrame(
        data, "event_id string, received_at timestamp, batch_id string, position int, build_id string"
    )
    assert rows(dedupe.first_per_event(df), "batch_id", "position") == [("b1", 0)]


# ---------------------------------------------------------------- requests

REQUESTS = "request_id string, api_key_id string, nonce string, received_at timestamp"


def replay_fold(data, window_s):
    """Ids of replays, one request after the other as they arrive."""
    opened, replays = {}, set()
    for request_id, key, nonce, at in sorted(data, key=lambda r: (r[3], r[0])):
        slot = (key, nonce.lower())
        if slot in opened and at < opened[slot] + timedelta(seconds=window_s):
            replays.add(request_id)
        else:
            opened[slot] = at
    return replays


def random_requests(seed, n=500, span_s=12_000):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        nonce = "HOT" if rng.random() < 0.34 else f"n{rng.randrange(60)}"
        nonce = rng.choice([nonce, nonce.lower()])
        at = START + timedelta(milliseconds=rng.randrange(0, span_s * 1000, 500))
        data.append((f"r{i:04d}", f"k{rng.randrange(2)}", nonce, at))
    return data


@pytest.mark.parametrize("seed", [5, 6])
def test_replay_equals_a_fold(spark, seed):
    data = random_requests(seed)
    flagged = replay.replay_flags(spark.createDataFrame(data, REQUESTS), 300)
    found = {r[0] for r in rows(flagged.filter("is_replay"), "request_id")}
    assert flagged.count() == len(data)
    assert found == replay_fold(data, 300)


def test_replay_window_edges_and_eligibility(spark):
    def at(seconds):
        return START + timedelta(seconds=seconds)

    data = [
        ("a", "k", "N", at(0), True),
        ("b", "k", "n", at(299.999), True),
        ("c", "k", "N", at(300), True),
        ("d", "k", "n", at(599), True),
        ("e", "k", "n", at(601), True),
        ("f", "k", "x", at(0), False),
        ("g", "k", "x", at(1), True),
    ]
    df = spark.createDataFrame(data, REQUESTS + ", ok boolean")
    flagged = replay.replay_flags(df, 300, F.col("ok"))
    assert {r[0] for r in rows(flagged.filter("is_replay"), "request_id")} == {"b", "d"}


def test_rate_pressure_equals_a_scan(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(5)}"
        data.append((key, START + timedelta(milliseconds=rng.randrange(0, 300_000, 250))))
    df = spark.createDataFrame(data, "api_key_id string, received_at timestamp")
    found = {}
    for r in requests.rate_pressure(df, "api_key_id", 30, 60).collect():
        found[(r.api_key_id, r.at_ms)] = (r.requests, r.trailing_60s, r.trailing_10s, r.over_sustained)
    expected = {}
    times = [(key, int(at.timestamp() * 1000)) for key, at in data]
    for key, ms in set(times):
        def trailing(width):
            return sum(1 for k, t in times if k == key and ms - width < t <= ms)

        own, minute = times.count((key, ms)), trailing(60_000)
        expected[(key, ms)] = (own, minute, trailing(10_000), max(0, min(minute - 30, own)))
    assert found == expected


def test_rate_pressure_golden(spark):
    times = [0, 0, 0, 61_000]
    data = [("ip", START + timedelta(milliseconds=t)) for t in times]
    df = spark.createDataFrame(data, "ip_prefix string, received_at timestamp")
    found = requests.rate_pressure(df, "ip_prefix", 2, 12).orderBy("at_ms")
    assert rows(found, "requests", "over_sustained", "over_burst") == [(3, 1, 1), (1, 0, 0)]
    assert requests.burst_limit(12) == 2 and requests.burst_limit(1) == 1
    assert requests.burst_limit(1200) == 200


def test_timestamp_reasons(spark):
    good = "91d0c7aa-55e3-4b6f-9b02-3f1e7d88a640"
    now = utc("2026-04-05T12:00:00")
    second = int(now.timestamp())
    data = [
        (good, str(second), now),
        (good.upper(), str(second - 300), now),
        (good, str(second - 301), now),
        (good, str(second + 301), now),
        (good, "9" * 30, now),
        (good, "12a", now),
        (good, None, now),
        (good.replace("4b6f", "1b6f"), str(second), now),
        (good + "\n", str(second), now),
        (good, str(second) + "\n", now),
    ]
    df = spark.createDataFrame(data, "nonce string, timestamp string, received_at timestamp")
    reason = [r[0] for r in rows(requests.timestamp_reasons(df, 300), "time_reason")]
    late = "timestamp_out_of_window"
    assert reason == [None, None, late, late, late, *["bad_request"] * 5]


def test_replay_blocks_that_stand_alone_need_no_links(spark, monkeypatch):
    """Bursts of some windows with silence around them are folded; only blocks that touch are linked."""
    day = 86_400
    hot = [(d * day + s) for d in range(3) for s in range(0, 1000, 7)]
    data = [(f"h{i}", "k", "hot", START + timedelta(seconds=s)) for i, s in enumerate(hot)]
    monkeypatch.setattr(replay, "_window_starts", None)
    found = replay.replay_flags(spark.createDataFrame(data, REQUESTS), 300)
    assert {r[0] for r in rows(found.filter("is_replay"), "request_id")} == replay_fold(data, 300)


def test_replay_over_the_edges_of_blocks(spark):
    """A nonce without any silence over many blocks, beside one whose blocks stand alone."""
    long = [(f"l{i:04d}", "k", "long", START + timedelta(seconds=37 * i)) for i in range(400)]
    edge = [(f"e{i}", "k", "edge", START + timedelta(seconds=s)) for i, s in enumerate((900, 1199, 1201, 1499.5, 1500, 5000, 5299, 5301))]
    data = long + edge
    found = replay.replay_flags(spark.createDataFrame(data, REQUESTS), 300)
    assert {r[0] for r in rows(found.filter("is_replay"), "request_id")} == replay_fold(data, 300)


def test_rate_pressure_adds_a_row_once(spark):
    """Frames only grow, so a pass over a dense key is linear; demand runs on over the edge of a block."""
    base = int(START.timestamp()) // 600 * 600
    times = [599_990 + 7 * i for i in range(0, 9000, 3)]
    df = spark.createDataFrame([("k", t) for t in times], "api_key_id string, t bigint")
    log = df.withColumn("received_at", F.timestamp_millis(F.col("t") + base * 1000))
    found = requests.rate_pressure(log, "api_key_id", 30, 60)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$()") == 4 == plan.count("specifiedwindowframe(")
    got = {r.at_ms - base * 1000: (r.trailing_60s, r.trailing_10s) for r in found.collect()}
    assert got == {t: tuple(sum(t - w < x <= t for x in times) for w in (60_000, 10_000)) for t in times}
