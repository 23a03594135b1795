import json
import random
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventlens import Settings, streaming
from eventlens.operators import daily, quality, requests
from eventlens.plans import ingest, refresh
from eventlens.sources import tables
from eventlens.sources.batches import read_bodies, read_offline_events, read_requests
from tests.factories import event, frame, rows, utc, wire
from tests.test_ordered import REQUESTS, random_requests, replay_fold
from tests.test_validation import body, credentials, request, uid

AS_OF = utc("2026-04-05T12:00:00")
SETTINGS = Settings()


def test_append_counts_only_new_ids(spark, tmp_path):
    raw = str(tmp_path / "raw")
    events = [event("level_end", "2026-04-05T10:00:00", "p") for _ in range(5)]
    assert tables.append_events(frame(spark, events + events[:2]), raw) == 5
    assert tables.append_events(frame(spark, events), raw) == 0
    more = [event("session_end", "2026-04-04T10:00:00", "p")]
    assert tables.append_events(frame(spark, events[:1] + more), raw) == 1
    stored = tables.read_events(spark, raw)
    assert stored.count() == 6
    assert {r[0] for r in rows(stored, "event_group")} == {"custom", "session_end"}
    assert tables.prune_raw(spark, raw, AS_OF, 0) == ["event_date=2026-04-04"]
    assert tables.read_events(spark, raw).count() == 5


def test_name_filter_prunes_partitions(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, [event("session_end", "2026-04-05T10:00:00", "p", duration_s=1)]), raw)
    stats = daily.session_stats(tables.read_events(spark, raw))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "event_group" in plan.split("PartitionFilters")[1].split("]")[0]


def test_ingest_batch_is_atomic_and_repeatable(spark, tmp_path):
    raw, refused = str(tmp_path / "raw"), str(tmp_path / "rejects")
    twice = wire("level_end", event_id=uid(1))
    bodies = [
        body(twice, twice, wire("session_end", event_id=uid(2))),
        body(twice),
        body(wire("level_end", event_id=uid(3)), wire("level_end", event_id=uid(4), props={"email": "x"})),
    ]
    landed = request(spark, bodies)
    report = ingest.ingest(landed, credentials(spark), raw, SETTINGS, refused)
    assert (report.accepted, report.rejected_requests) == (2, 1)
    again = ingest.ingest(landed, credentials(spark), raw, SETTINGS, refused)
    assert again.accepted == 0
    stored = {r.event_id: r for r in tables.read_events(spark, raw).collect()}
    assert set(stored) == {uid(1), uid(2)}
    assert json.loads(stored[uid(2)].props_json)["duration_s"] == 86400
    assert stored[uid(1)].ingest_source == "godot_sdk" and stored[uid(1)].locale is None


def test_readers_keep_broken_lines(spark, tmp_path):
    landed = tmp_path / "requests.json"
    line = {"batch_id": "b", "api_key_id": "k", "received_at": "2026-04-05T12:00:00Z", "body": "{"}
    landed.write_text(json.dumps(line) + "\nnot json\n")
    found = rows(read_requests(spark, str(landed)), "body", "unreadable", "batch_id")
    assert [r[:2] for r in found] == [("{", False), ("not json", True)]
    assert found[0][2] == "b" and found[1][2].startswith("unreadable-")
    bodies = tmp_path / "bodies.json"
    bodies.write_text('{"events": []}\n\n{"events": []}\n')
    assert rows(read_bodies(spark, str(bodies), "k"), "api_key_id", "body") == [("k", '{"events": []}')] * 2
    offline = tmp_path / "events.log"
    offline.write_text('{"event_id": "a"}\n\n[1]\n5\n{"broken"\n  {"event_id": "b"}\n')
    assert read_offline_events(spark, str(offline)).count() == 2


def test_refresh_all_publishes_and_reports(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "tables")
    events = [event("session_end", "2026-04-05T10:00:00", f"p{i}", duration_s=60) for i in range(12)]
    events += [event("session_start", "2026-04-04T10:00:00", f"p{i}") for i in range(12)]
    events += [event("character_selected", "2026-04-05T10:00:00", "p1", character_id="w")]
    assert ingest.seed(frame(spark, events), raw) == 25
    for _ in range(3):
        report = refresh.run_job(spark, "refresh:all", raw, out, SETTINGS, AS_OF).first()
    assert (report.command, report.status, report.cohort_count) == ("refresh:all", "ok", 1)
    assert refresh.ensure_calendar(spark, out, SETTINGS) == 0
    report = {r.table_name: r.row_count for r in refresh.table_report(spark, out).collect()}
    assert report["retention_cohorts"] == 1 and report["metrics_summary_current"] == 2
    lag = requests.refresh_lag(refresh.table_report(spark, out), F.lit(utc("2026-04-05T12:15:01")), 900)
    assert {(r.lag_s, r.lag_alert) for r in lag.collect()} == {(901, True)}
    names = refresh.register_views(spark, out)
    assert len(names) == 5
    assert spark.sql("select sum(active_players) from sessions_daily").first()[0] == 12
    assert tables.latest(spark, f"{out}/sessions_daily").count() == 2 * 2557
    # Snapshots go by age, so all of the last day are there.
    snapshots = [p.name for p in (tmp_path / "tables" / "sessions_daily").glob("snapshot=*")]
    assert sorted(snapshots) == [f"snapshot={n:012d}" for n in (1, 2, 3)]
    with pytest.raises(ValueError):
        refresh.refresh_table(spark, "events_raw", raw, out, SETTINGS, AS_OF)
    with pytest.raises(ValueError):
        refresh.run_job(spark, "seed:demo", raw, out, SETTINGS)
    tables.reset(spark, raw, f"{out}/retention_cohorts", tables.latest(spark, f"{out}/retention_cohorts").limit(0))
    assert tables.read_events(spark, raw).count() == 0
    assert tables.latest(spark, f"{out}/retention_cohorts").count() == 0


def test_refresh_stops_at_the_first_failure(spark, tmp_path, monkeypatch):
    done = []

    def failing(spark, name, *rest):
        done.append(name)
        if name == "character_popularity":
            raise RuntimeError(name)

    monkeypatch.setattr(refresh, "refresh_table", failing)
    monkeypatch.setattr(refresh, "ensure_calendar", lambda *rest: done.append("calendar"))
    with pytest.raises(RuntimeError):
        refresh.refresh_rolling(spark, "", "", SETTINGS, AS_OF)
    assert done == ["calendar", "sessions_daily", "character_popularity"]


def test_session_days_stream_follows_late_events(spark, tmp_path):
    raw, target, state = (str(tmp_path / n) for n in ("raw", "days", "state"))

    def land_and_run(events):
        tables.append_events(frame(spark, events), raw)
        streaming.session_days_stream(spark, raw, target, state).awaitTermination()
        found = streaming.session_days(spark, target).orderBy("metric_date")
        return rows(found, "session_count", "active_players", "avg_session_length_s")

    first = [event("session_end", f"2026-04-0{d}T10:00:00", "p", duration_s=5) for d in (1, 2)]
    assert land_and_run(first) == [(1, 1, 5), (1, 1, 5)]
    late = [event("session_end", "2026-04-01T11:00:00", p, duration_s=8) for p in ("p", "q")]
    assert land_and_run(late) == [(3, 2, 7), (1, 1, 5)]
    assert land_and_run([event("level_end", "2026-04-01T11:00:00", "p")]) == [(3, 2, 7), (1, 1, 5)]


def test_idle_sessions_stream_equals_batch(spark, tmp_path):
    start = datetime(2026, 4, 1, tzinfo=timezone.utc)
    minutes = [0, 10, 40, 69, 200, 230]
    events = [
        event("click", (start + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S"), "p") for m in minutes
    ]
    df = frame(spark, events)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = (
        streaming.idle_sessions(stream, delay="1 hour")
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(target)
    )
    query.awaitTermination()
    batch = sorted(rows(streaming.idle_sessions(df), "started_at", "event_count"))
    assert [n for _, n in batch] == [2, 2, 1, 1]
    closed = sorted(rows(spark.read.parquet(target), "started_at", "event_count"))
    # The watermark closes the sessions that ended before it.
    assert closed == batch[: len(closed)] and len(closed) >= 2


def test_replay_stream_equals_batch(spark, tmp_path):
    data = sorted(random_requests(8, n=240), key=lambda r: (r[3], r[0]))
    source, target = tmp_path / "in", str(tmp_path / "out")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("replay-*"))
    for part in range(4):
        chunk = data[part * 60 : (part + 1) * 60]
        spark.createDataFrame(chunk, REQUESTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(REQUESTS).parquet(str(source))
        streaming.replay_stream(
            stream, target, str(tmp_path / "open"), str(tmp_path / "state"), 300
        ).awaitTermination()
    from eventlens.streaming.jobs import replay_results

    # No table of the computation and no old state is left.
    assert set(shared.glob("replay-*")) == before
    assert sorted(p.name for p in (tmp_path / "open").iterdir()) == ["batch=2", "batch=3"]
    streamed = replay_results(spark, target)
    assert streamed.count() == len(data)
    assert {r[0] for r in rows(streamed.filter("is_replay"), "request_id")} == replay_fold(data, 300)


def test_weekly_cohorts_need_new_players(spark):
    weeks = [f"2026-0{m}-{d:02d}T10:00:00" for m, d in ((1, 5), (1, 12), (1, 19), (1, 26), (2, 2), (2, 9), (2, 16), (2, 23))]
    same = [event("session_start", at, "p") for at in weeks]
    fresh = [event("session_start", at, f"p{k}", game="beta") for k, at in enumerate(weeks)]
    found = quality.dataset_checks(frame(spark, same + fresh), ("alpha", "beta"), AS_OF)
    cohorts = {r.game_id: (r.value, r.ok) for r in found.filter("check = 'weekly_cohorts'").collect()}
    assert cohorts == {"alpha": (1, False), "beta": (8, True)}


def test_dataset_checks_and_bad_numbers(spark):
    events = [event("session_end", "2026-04-05T11:50:00", "p", duration_s="x")]
    events += [event("session_end", "2026-04-05T11:50:00", "p")]
    events += [event("session_end", "2026-04-05T11:50:00", "p", duration_s="12")]
    df = frame(spark, events)
    found = quality.dataset_checks(df, ("alpha", "beta"), AS_OF).collect()
    checks = {r.check: r for r in found if r.game_id == "alpha"}
    empty = [r for r in found if r.game_id == "beta"]
    assert len(empty) == len(checks) and not any(r.ok or r.value for r in empty)
    assert checks["fresh_events"].ok and checks["fresh_events"].value == 3
    assert not checks["volume_session_end"].ok and not checks["consent_off_share"].ok
    assert rows(quality.bad_numbers(df, "session_end", "duration_s"), "missing", "not_numeric") == [(1, 1)]
    share = quality.suppressed_share(spark.createDataFrame([(True,), (True,), (False,)], "suppressed boolean"))
    assert rows(share) == [(3, 2, True)]


def test_incremental_refresh_equals_a_full_one(spark, tmp_path):
    """Three landings with late events and a reset in between; all published rows are compared."""
    rng = random.Random(12)
    settings = Settings(calendar_start=date(2026, 3, 20), calendar_end=date(2026, 4, 20))
    names = ["session_start", "session_end", "match_end", "character_selected"]

    def landing(days):
        made = [
            event(
                rng.choice(names), f"2026-{rng.choice(days)}T{rng.randrange(24):02d}:00:00", f"p{rng.randrange(9)}",
                game=rng.choice(settings.games), duration_s=rng.randrange(900), character_id=rng.choice("xyz"),
            )
            for _ in range(60)
        ]
        return frame(spark, made)

    raw, one, all_ = (str(tmp_path / n) for n in ("raw", "touched", "full"))
    for k, days in enumerate((["03-29", "03-30"], ["04-05"], ["04-05", "03-29", "04-04"], ["04-04"])):
        if k == 3:
            empty = tables.latest(spark, f"{one}/retention_cohorts").limit(0)
            tables.reset(spark, raw, f"{one}/retention_cohorts", empty)
        tables.append_events(landing(days), raw)
        refresh.run_job(spark, "refresh:all", raw, one, settings, AS_OF, incremental=True)
        refresh.run_job(spark, "refresh:all", raw, all_, settings, AS_OF)
        for name in (*refresh.ROLLING, refresh.RETENTION):
            found, expected = (sorted(map(str, tables.latest(spark, f"{t}/{name}").collect())) for t in (one, all_))
            assert found == expected, (k, name)
        assert tables.touched(spark, raw, "rolling") == ([], [])


def test_incremental_refresh_reads_only_the_new_dates(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "tables")
    tables.append_events(frame(spark, [event("session_end", "2026-04-01T10:00:00", "p", duration_s=1)]), raw)
    refresh.run_job(spark, "refresh:all", raw, out, Settings(), AS_OF)
    tables.append_events(frame(spark, [event("session_end", "2026-04-05T10:00:00", "p", duration_s=1)]), raw)
    assert tables.touched(spark, raw, "rolling")[1] == [date(2026, 4, 5)]
    # A file of another date that cannot be read is in nobody's way.
    for path in (tmp_path / "raw" / "event_date=2026-04-01").rglob("*.parquet"):
        path.write_bytes(b"broken")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    refresh.run_job(spark, "refresh:rolling", raw, out, Settings(), AS_OF, incremental=True)
    table = tables.latest(spark, f"{out}/sessions_daily").filter("session_count > 0 and game_id = 'alpha'")
    assert sorted(rows(table, "metric_date")) == [(date(2026, 4, 1),), (date(2026, 4, 5),)]
