"""Row groups of stored events lie by name, and scans for one name skip the others."""

import random

import pytest
from pyspark.sql import functions as F

from eventlens.plans import metrics
from eventlens.sources import tables
from tests.factories import event, frame
from tests.test_jobs import AS_OF

NAMES = [f"step_{i:03d}" for i in range(40)]


def stored(spark, path, monkeypatch, seed=1, n=6_000):
    monkeypatch.setattr(tables, "ROW_GROUP", 16 << 10)
    rng, out = random.Random(seed), []
    for i in range(n):
        e = event(rng.choice(NAMES), "2026-04-05T10:00:00", f"p{rng.randrange(500)}")
        e["event_id"] = f"{i:08d}"
        out.append(e)
    tables.append_events(frame(spark, out), path)
    return out


def rows_read(scan):
    """Rows that come out of the one scan of a frame."""
    run = scan._jdf.queryExecution()
    run.toRdd().count()
    plan = run.executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("name", ["step_007", "step_0075", "absent"])
def test_a_name_reads_its_row_groups(spark, tmp_path, monkeypatch, name):
    path = str(tmp_path / "raw")
    events = stored(spark, path, monkeypatch)
    scan = tables.read_events(spark, path).filter(F.col("event_name") == name).select("event_id")
    own = sum(e["event_name"] == name for e in events)
    assert scan.count() == own
    assert rows_read(scan) <= (len(events) // 4 if own else 0)


def test_a_purge_keeps_the_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    events = stored(spark, path, monkeypatch, seed=2)
    gone = events[0]["player_id_hash"]
    tables.purge_players(spark, path, spark.createDataFrame([(gone,)], "player_id_hash string"))
    kept = [e for e in events if e["player_id_hash"] != gone]
    scan = tables.read_events(spark, path).filter(F.col("event_name") == "step_007").select("event_id")
    assert scan.count() == sum(e["event_name"] == "step_007" for e in kept)
    assert rows_read(scan) <= len(kept) // 4


def test_counts_of_a_stored_name(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    events = stored(spark, path, monkeypatch, seed=3, n=600)
    counts = metrics.custom_counts(tables.read_events(spark, path), "step_003", AS_OF, days=30)
    total = sum(r["event_count"] for r in counts.collect())
    assert total == sum(e["event_name"] == "step_003" and e["consent_analytics"] for e in events)
