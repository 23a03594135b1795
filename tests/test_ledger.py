import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import dedupe
from eventlens.sources import ledger, tables
from tests.factories import event, frame
from tests.test_jobs import AS_OF


def events_of(ids, day="2026-04-05"):
    out = []
    for i in ids:
        e = event("level_end", f"{day}T10:00:00", "p")
        e["event_id"] = f"{i:08d}"
        out.append(e)
    return out


def stored_ids(spark, raw):
    return sorted(int(r.event_id) for r in tables.read_events(spark, raw).select("event_id").collect())


@pytest.mark.parametrize("literal", [2_000, 0])
def test_random_appends_equal_a_set(spark, tmp_path, monkeypatch, literal):
    """Appends with ids known and new, by literals and by the join, through several merges."""
    monkeypatch.setattr(ledger, "LITERAL_IDS", literal)
    monkeypatch.setattr(ledger, "MERGED", 3)
    monkeypatch.setattr(ledger, "BUCKETS", 4)
    raw, rng, known = str(tmp_path / "raw"), random.Random(literal), set()
    for _ in range(10):
        ids = [rng.randrange(60) for _ in range(12)]
        assert tables.append_events(frame(spark, events_of(ids)), raw) == len(set(ids) - known)
        known |= set(ids)
    assert stored_ids(spark, raw) == sorted(known)
    book = ledger.Ledger(spark, raw)
    assert book.runs() == [(1, 9), (10, 10)]
    assert sorted(n for n in book._names() if n.startswith("run=")) == [f"run={1:012d}-{9:012d}", f"run={10:012d}-{10:012d}"]


@pytest.mark.parametrize("failing", ["events", "commit", "ids"])
def test_an_append_that_fails_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, failing):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, events_of(range(5))), raw)
    book = ledger.Ledger(spark, raw)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if failing == "events":
            m.setattr(tables, "_with_partitions", broken)
        elif failing == "commit":
            m.setattr(ledger.Ledger, "commit", broken)
        else:
            m.setattr(ledger.Ledger, "_write", broken)
        with pytest.raises(RuntimeError):
            tables.append_events(frame(spark, events_of(range(3, 9))), raw)
    added = tables.append_events(frame(spark, events_of(range(3, 12))), raw)
    assert added == (3 if failing == "commit" else 7)
    assert stored_ids(spark, raw) == list(range(12))
    assert not [n for n in book._names() if n.startswith(("pending", "building"))]


def test_a_table_without_a_ledger_gets_one(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, events_of(range(5))), raw)
    ledger.Ledger(spark, raw).clear()
    assert tables.append_events(frame(spark, events_of(range(7))), raw) == 2


def test_deleted_dates_free_their_ids(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, events_of(range(5), "2026-01-01")), raw)
    tables.append_events(frame(spark, events_of(range(5, 8))), raw)
    assert tables.prune_raw(spark, raw, AS_OF, 30) == ["event_date=2026-01-01"]
    assert tables.append_events(frame(spark, events_of(range(3, 8))), raw) == 2
    tables.reset(spark, raw, str(tmp_path / "cohorts"), spark.range(0))
    assert tables.append_events(frame(spark, events_of(range(8))), raw) == 8


def _scan(frame):
    """Row groups and rows that the scans of a frame have read."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan


def test_a_lookup_reads_the_touched_buckets_and_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKETS", 8)
    monkeypatch.setattr(ledger, "ROW_GROUP", 8 << 10)
    monkeypatch.setattr(ledger, "PAGE", 1 << 10)
    raw = str(tmp_path / "raw")
    tables.append_events(frame(spark, events_of(range(0, 40_000, 2))), raw)
    book = ledger.Ledger(spark, raw)
    asked = spark.createDataFrame([("00000010",), ("00000011",)], "event_id string")
    found = book.seen(asked)
    assert [r.event_id for r in found.collect()] == ["00000010"]
    plan = _scan(found)
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(event_id" in plan.split("PushedFilters: [")[1].split("]]")[0]
    # An id that is in no row group: nothing comes out of the scan but what Bloom filters let pass.
    scan = spark.read.schema("event_id string").parquet(f"{book.path}/run={1:012d}-{1:012d}")
    rows = scan.filter(F.col("event_id").isin(["00000011", "00000013"]))._jdf.queryExecution()
    rows.toRdd().count()
    leaf = rows.executedPlan().collectLeaves().head()
    read = leaf.metrics().apply("numOutputRows").value()
    assert read < 2_000


def test_a_batch_without_new_ids_is_not_ordered(spark, tmp_path, monkeypatch):
    """Its dates are listed all the same: the run before may have failed behind its events."""
    raw = str(tmp_path / "raw")
    assert tables.append_events(frame(spark, events_of(range(3))), raw) == 3
    for path in tables.touched(spark, raw, "rolling")[0]:
        tables.remove(spark, path)
    ordered = tables.first_per_event
    monkeypatch.setattr(tables, "first_per_event", lambda events: ordered(events).filter(F.raise_error(F.lit("ordered")).isNull()))
    assert tables.append_events(frame(spark, events_of(range(3))), raw) == 0
    assert ledger.Ledger(spark, raw).runs() == [(1, 1), (2, 2)]
    assert tables.touched(spark, raw, "rolling")[1]
    assert stored_ids(spark, raw) == [0, 1, 2]


def arrivals(ids):
    """Events of which a later arrival of an id is another player's."""
    out = events_of(ids)
    for n, e in enumerate(out):
        e["player_id_hash"], e["received_at"] = f"p{n:02d}", e["received_at"].replace(minute=59 - n)
    return out


def test_only_rows_of_repeated_ids_are_ordered(spark, tmp_path, monkeypatch):
    raw, ordered, counts = str(tmp_path / "raw"), dedupe.first_per_event, []

    def counting(events, *order):
        counts.append(events.count())
        return ordered(events, *order)

    for module in (tables, dedupe):
        monkeypatch.setattr(module, "first_per_event", counting)
    assert tables.append_events(frame(spark, arrivals([*range(20), 3, 3])), raw) == 20
    assert counts == [3]
    assert stored_ids(spark, raw) == list(range(20))
    won = tables.read_events(spark, raw).filter("event_id = '00000003'").first()
    assert won.player_id_hash == "p21"
    assert tables.append_events(frame(spark, arrivals(range(5, 25))), raw) == 5
    assert counts == [3, 0]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_few_and_many_repeated_ids_give_the_same_rows(spark, tmp_path, monkeypatch, bound):
    """A bound of 0 orders rows of repeated ids only, a large one orders all rows."""
    monkeypatch.setattr(tables, "ORDER_ALL", bound)
    raw = str(tmp_path / "raw")
    assert tables.append_events(frame(spark, arrivals([1, 2, 3, 2, 4, 1, 1])), raw) == 4
    assert tables.append_events(frame(spark, arrivals([9, 1, 5, 5, 9])), raw) == 2
    found = {int(r.event_id): r.player_id_hash for r in tables.read_events(spark, raw).collect()}
    assert found == {1: "p06", 2: "p03", 3: "p02", 4: "p04", 5: "p03", 9: "p04"}
    book = ledger.Ledger(spark, raw)
    assert sorted(int(r.event_id) for r in book._read(book.runs()).collect()) == [1, 2, 3, 4, 5, 9]


def test_first_of_repeated_equals_first_per_event(spark):
    """Null ids too, which are one id."""
    rng = random.Random(5)
    made = [(rng.choice([None, *"abcdefghij"]), rng.randrange(3), rng.randrange(4)) for _ in range(30)]
    events = spark.createDataFrame([*made, ("once", 1, 1)], "event_id string, received_at int, x int")
    repeated = events.groupBy("event_id").count().filter("count > 1").select("event_id")
    some, each = dedupe.first_of_repeated(events, repeated), dedupe.first_per_event(events)
    assert sorted(map(str, some.collect())) == sorted(map(str, each.collect()))
