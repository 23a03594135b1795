import random
from datetime import timedelta

from pyspark.sql import functions as F

from eventlens import streaming
from eventlens.operators import quality, sessions
from tests.factories import event, frame, rows, utc
from tests.test_ordered import REQUESTS, random_requests, replay_fold


def run(stream, tmp_path):
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def feed(spark, parts, path):
    """One file and micro-batch for each part."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_numbered_sessions_equal_the_batch(spark, tmp_path):
    """Events up to 40 minutes out of order, ties, start events, and one later than the delay."""
    rng, start = random.Random(3), utc("2026-04-01T00:00:00")
    made = []
    for k in range(300):
        at = start + timedelta(minutes=rng.randrange(0, 900, 5))
        e = event(rng.choice(("click", "click", "session_start")), at.strftime("%Y-%m-%dT%H:%M:%S"), f"p{k % 4}")
        made.append((at + timedelta(minutes=rng.randrange(40)), e))
    made.sort(key=lambda x: x[0])
    events = [e for _, e in made]
    parts = [frame(spark, events[k : k + 75]) for k in range(0, 300, 75)]
    late = event("click", "2026-04-01T00:01:00", "p0")
    parts.append(frame(spark, [event("click", "2026-05-01T00:00:00", "~")]))
    parts.append(frame(spark, [late]))
    found = run(streaming.numbered_sessions(feed(spark, parts, tmp_path / "in"), "1 hour"), tmp_path)
    expected = sessions.sessionize(frame(spark, events))
    assert sorted(rows(found.filter("player_id_hash <> '~'"), "event_id", "session_no")) == sorted(rows(expected, "event_id", "session_no"))


def test_replay_windows_equal_a_fold_and_leave_no_state(spark, tmp_path):
    data = sorted(random_requests(8, n=240), key=lambda r: (r[3], r[0]))
    parts = [spark.createDataFrame(data[k : k + 60], REQUESTS) for k in range(0, 240, 60)]
    stream = feed(spark, parts, tmp_path / "in")
    query = (
        streaming.replay_windows(stream, 300, "10 minutes").writeStream.outputMode("append").queryName("replays")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("memory").start()
    )
    query.awaitTermination()
    found = spark.table("replays")
    assert found.count() == len(data)
    assert {r.request_id for r in found.filter("is_replay").collect()} == replay_fold(data, 300)
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    nonces = len({(r[1], r[2].lower()) for r in data})
    assert held < nonces


def test_orphans_equal_the_batch(spark, tmp_path):
    rng, start = random.Random(4), utc("2026-04-01T00:00:00")
    made = []
    for k in range(120):
        at = start + timedelta(minutes=10 * k + rng.randrange(9))
        made.append(event(rng.choice(("match_start", "match_end", "click")), at.strftime("%Y-%m-%dT%H:%M:%S"), f"m{rng.randrange(12)}:{k // 40}"))
    parts = [frame(spark, made[k : k + 40]) for k in range(0, 120, 40)]
    parts.append(frame(spark, [event(n, "2026-06-01T00:00:00", "~") for n in ("match_start", "match_end")]))
    match = F.col("player_id_hash")
    found = run(streaming.orphan_stream(feed(spark, parts, tmp_path / "in"), match, "1 hour", "24 hours"), tmp_path)
    expected = rows(quality.orphan_matches(frame(spark, made), match), "event_id")
    assert expected and sorted(rows(found, "event_id")) == sorted(expected)


def test_a_batch_of_alert_counts_that_runs_again_changes_nothing(spark, tmp_path):
    log = spark.createDataFrame(
        [("ingest", utc(f"2026-04-0{d}T10:0{m}:00"), 500 if m == 3 else 200, 10) for d in (1, 2) for m in range(5)],
        "service string, received_at timestamp, status_code int, latency_ms int",
    )
    path, cells = tmp_path / "in", str(tmp_path / "cells")
    for name in ("state", "again"):  # a new checkpoint reads all batches a second time
        stream = feed(spark, [log], path) if name == "state" else spark.readStream.schema(log.schema).parquet(str(path))
        streaming.alert_stream(stream, cells, str(tmp_path / name), "1 day").awaitTermination()
        assert sorted(rows(streaming.live_alerts(spark, cells), "service", "requests", "breaches", "alert"))[:2] == [("ingest", 5, 0, "latency_p95"), ("ingest", 5, 0, "latency_p95")]
        fired = streaming.live_alerts(spark, cells).filter("firing")
        assert [r.breaches for r in fired.collect()] == [1, 1]
