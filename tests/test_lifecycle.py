import pytest
from pyspark.sql import functions as F

from eventlens import Settings
from eventlens.plans import refresh
from eventlens.sources import tables
from tests.factories import event, frame, rows
from tests.test_jobs import AS_OF

SETTINGS = Settings()


def test_two_publishes_at_once_keep_both(spark, tmp_path, monkeypatch):
    """The second writer starts and ends while the first one writes."""
    path = str(tmp_path / "t")
    tables.publish(spark.range(1), path)
    first = tables._reserve(spark, path)
    assert tables.publish(spark.range(3), path).endswith(f"{first + 1:012d}")
    monkeypatch.setattr(tables, "_reserve", lambda *_: first)
    tables.publish(spark.range(2), path)
    assert tables._snapshots(spark, path) == [1, 2, 3]
    assert tables.latest(spark, path).count() == 3


def test_a_reader_outlives_later_publishes(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(5), path)
    reader = tables.latest(spark, path)
    for n in range(3):
        tables.publish(spark.range(n), path)
    assert reader.count() == 5
    tables.publish(spark.range(9), path, keep_s=0)
    assert tables._snapshots(spark, path) == [5]


def history():
    """Players of several days; the oldest days will be deleted."""
    out = []
    for k in range(14):
        for day in (1, 2, 8, 20, 21, 27):
            if (k + day) % 4:
                out.append(event("session_start", f"2026-03-{day:02d}T09:00:00", f"p{k:02d}"))
                out.append(event("session_end", f"2026-03-{day:02d}T10:00:00", f"p{k:02d}", duration_s=60 + k))
                out.append(event("character_selected", f"2026-03-{day:02d}T09:30:00", f"p{k:02d}", character_id="c"))
    return out


def published(spark, made):
    return {
        name: sorted(map(str, rows(tables.latest(spark, f"{made}/{name}").drop("last_refreshed_at"))))
        for name in (*refresh.ROLLING, refresh.RETENTION)
    }


def test_both_modes_agree_after_a_prune_and_a_purge(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, history()), raw)
    places = {mode: str(tmp_path / mode) for mode in ("full", "incremental")}

    def both():
        found = {}
        marks = tables.touched(spark, raw, "rolling")[0]
        for mode, made in places.items():
            # Each mode sees the same landings: the lists are read before the other clears them.
            for name in refresh.ROLLING:
                days = tables.touched(spark, raw, "rolling")[1] if mode == "incremental" else None
                refresh.ensure_calendar(spark, made, SETTINGS)
                refresh.refresh_table(spark, name, raw, made, SETTINGS, AS_OF, days)
            days = tables.touched(spark, raw, "retention")[1] if mode == "incremental" else None
            refresh.refresh_table(spark, refresh.RETENTION, raw, made, SETTINGS, AS_OF, days)
            found[mode] = published(spark, made)
        for path in [*marks, *tables.touched(spark, raw, "retention")[0]]:
            tables.remove(spark, path)
        assert found["full"] == found["incremental"]
        return found["full"]

    before = both()
    assert tables.prune_raw(spark, raw, AS_OF, 20) == [f"event_date=2026-03-{d:02d}" for d in (1, 2, 8)]
    assert both() == before
    # Late events of a deleted date change nothing, those of a kept date do.
    tables.append_events(frame(spark, [event("session_end", f"2026-03-{d}T11:00:00", "p00", duration_s=1) for d in ("02", "20")]), raw)
    after = both()
    assert after != before and [r for r in after["sessions_daily"] if "3, 2)" in r] == [r for r in before["sessions_daily"] if "3, 2)" in r]
    players = spark.createDataFrame([("p03",), ("nobody",)], "player_id_hash string")
    for made in places.values():
        files, gone = refresh.purge(spark, raw, made, players)
    left = both()
    days = spark.read.parquet(f"{places['full']}/{refresh.PLAYER_DAYS}")
    assert days.filter("player_id_hash = 'p03'").count() == 0 and days.filter("player_id_hash = 'p02'").count()
    assert left["retention_cohorts"] != after["retention_cohorts"]


def test_purge_rewrites_only_files_that_hold_the_players(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, [event("level_end", f"2026-04-0{d}T10:00:00", p) for d, p in ((1, "a"), (1, "b"), (2, "b"))]), raw)

    def files():
        return {p.name for p in (tmp_path / "raw").rglob("part-*.parquet")}

    old = files()
    players = spark.createDataFrame([("a",)], "player_id_hash string")
    assert tables.purge_players(spark, raw, players) == (1, 1)
    assert len(old & files()) == 1 and len(files()) == 2
    assert sorted(rows(tables.read_events(spark, raw), "player_id_hash")) == [("b",), ("b",)]
    assert tables.purge_players(spark, raw, players) == (0, 0)
    assert [str(d) for d in tables.touched(spark, raw, "rolling")[1]] == ["2026-04-01", "2026-04-02"]


def test_a_purge_that_failed_is_completed(spark, tmp_path, monkeypatch):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, [event("level_end", "2026-04-01T10:00:00", p) for p in ("a", "b", "c")]), raw)
    finish, calls = tables._finish_purge, []

    def lost(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        finish(*args)

    monkeypatch.setattr(tables, "_finish_purge", lost)
    with pytest.raises(RuntimeError):
        tables.purge_players(spark, raw, spark.createDataFrame([("a",)], "player_id_hash string"))
    tables.purge_players(spark, raw, spark.createDataFrame([("b",)], "player_id_hash string"))
    assert rows(tables.read_events(spark, raw), "player_id_hash") == [("c",)]


def test_job_reports(spark, tmp_path):
    raw, made = str(tmp_path / "raw"), str(tmp_path / "tables")
    events = frame(spark, history())

    def run(command, **more):
        return refresh.run_job(spark, command, raw, made, SETTINGS, AS_OF, **more).first()

    seeded = run("seed:demo", events=events)
    assert (seeded.generated_count, seeded.inserted_count, seeded.status) == (events.count(), events.count(), "ok")
    assert run("seed:demo", events=events).inserted_count == 0
    gone = events.filter("player_id_hash = 'p03'")
    assert run("purge:players", opted_out=gone).removed_count == gone.count()
    assert run("prune:raw", days=20).removed_count == 3
    assert run("reset:raw").cohort_count is None
    assert tables.read_events(spark, raw).count() == 0
    with pytest.raises(ValueError):
        run("refresh:none")
