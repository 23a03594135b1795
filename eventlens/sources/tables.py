"""Raw and derived Parquet tables.

Raw events are partitioned by UTC date and event group (the five core names and ``custom``), so the
number of partitions does not grow with the number of custom names; inside a file events lie by name
and game, so reports on one name skip the other row groups. Derived tables are published
as complete snapshots in sub-directories; readers take the newest one that carries a success mark,
so a refresh never overwrites files that a reader has listed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventlens import schema
from eventlens.functions.scalars import is_core_name, utc_date
from eventlens.operators.dedupe import first_of_repeated, first_per_event
from eventlens.operators.filters import utc
from eventlens.sources.ledger import Ledger

#: Bytes of a row group of raw events: the unit that a scan for one event name skips.
ROW_GROUP = 16 << 20
_SNAPSHOT = re.compile(r"^snapshot=(\d{12})$")


def event_group(name: Column) -> Column:
    return F.when(is_core_name(name), name).otherwise("custom")


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    found = [int(match.group(1)) for match in map(_SNAPSHOT.match, names) if match]
    return sorted(n for n in found if exists(spark, f"{path}/snapshot={n:012d}/_SUCCESS"))


def _reserve(spark: SparkSession, path: str) -> int:
    """The next number, for this writer alone: an empty file by its name is created atomically."""
    folder, fs = _path(spark, f"{path}/_numbers")
    fs.mkdirs(folder)
    taken = [int(status.getPath().getName()) for status in fs.listStatus(folder)]
    number = max([*taken, *_snapshots(spark, path)], default=0) + 1
    while not fs.createNewFile(_path(spark, f"{path}/_numbers/{number:012d}")[0]):
        number += 1
    return number


def publish(df: DataFrame, path: str, keep_s: int = 86_400) -> str:
    """Write a complete new snapshot of a derived table.

    Writers that run at once take different numbers, and readers take the highest complete one. A
    snapshot goes when the next one has been complete for ``keep_s`` seconds, by the clock of the
    file system, so a reader that has listed its files has that long to end, however many are
    published meanwhile.
    """
    spark = df.sparkSession
    number = _reserve(spark, path)
    target = f"{path}/snapshot={number:012d}"
    df.write.mode("error").parquet(target)
    known = _snapshots(spark, path)
    _, fs = _path(spark, path)

    def completed(n: int) -> int:
        return fs.getFileStatus(_path(spark, f"{path}/snapshot={n:012d}/_SUCCESS")[0]).getModificationTime()

    now = completed(number)
    for old, following in zip(known, known[1:]):
        if now - completed(following) >= keep_s * 1000:
            remove(spark, f"{path}/snapshot={old:012d}")
            remove(spark, f"{path}/_numbers/{old:012d}")
    return target


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot of a derived table."""
    known = _snapshots(spark, path)
    if not known:
        raise FileNotFoundError(f"no published snapshot under {path}")
    return spark.read.parquet(f"{path}/snapshot={known[-1]:012d}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The raw events; an empty frame when nothing has landed yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema.EVENTS_STORED)
    return spark.read.schema(schema.EVENTS_STORED).parquet(path)


def _with_partitions(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", utc_date(F.col("occurred_at"))).withColumn(
        "event_group", event_group(F.col("event_name"))
    )


def _write_events(events: DataFrame, path: str, mode: str) -> None:
    """Write events with their partition columns.

    Hot partitions are split over tasks and small ones put together. Rows of a file lie by name,
    game and instant: the bounds and Bloom filters of row groups then tell which hold a name.
    """
    (
        events.hint("rebalance", "event_date", "event_group")
        .sortWithinPartitions("event_date", "event_group", "event_name", "game_id", "occurred_at")
        .write.mode(mode)
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.bloom.filter.enabled#event_name", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("event_date", "event_group")
        .parquet(path)
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; it outlives any executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    The context's cleaner removes the files when nothing refers to the frame any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _write_stage(df: DataFrame, name: str) -> str:
    target = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return target


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table, so that later reads know its true size.

    The table stays in the shared checkpoint folder, like a reliable checkpoint does.
    """
    return df.sparkSession.read.parquet(_write_stage(df, name))


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stage`` for the length of one job; the table is removed afterwards."""
    target = _write_stage(df, name)
    try:
        yield df.sparkSession.read.parquet(target)
    finally:
        hadoop_path, fs = _path(df.sparkSession, target)
        fs.delete(hadoop_path, True)


class Scratch:
    """Written tables of one computation, of which only its result outlives it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(_write_stage(df, self.name))
        return self.spark.read.parquet(self.paths[-1])

    def clear(self, keep: int = 0) -> None:
        """Remove the tables, except the last ``keep``."""
        for path in self.paths[: len(self.paths) - keep]:
            remove(self.spark, path)
        self.paths = self.paths[len(self.paths) - keep :]


def unseen(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` whose event_id is not in the frame ``stored``, which is read as a whole.

    The stored side is the large one: it is reduced to the ids of ``new`` first. An append to a
    stored table uses its ledger instead.
    """
    known = stored.select("event_id").join(new.select("event_id"), "event_id", "left_semi").distinct()
    return new.join(known, "event_id", "left_anti")


#: Refresh jobs that follow the dates of new events, each with its own list.
FOLLOWERS = ("rolling", "retention")
#: Dates up to which a refresh takes dates as literals, which prune partitions for sure. It bounds
#: what comes to the driver; beyond, the whole table is rebuilt.
MAX_TOUCHED = 20_000
#: A landing that stands for all dates.
EVERYTHING = "everything"


def _dates(batch: DataFrame) -> DataFrame:
    return batch.select(utc_date(F.col("occurred_at")).alias("event_date")).distinct()


def _touch(dates: DataFrame, path: str, landing: str) -> None:
    for follower in FOLLOWERS:
        dates.coalesce(1).write.mode("overwrite").parquet(f"{path}_touched/{follower}/{landing}")


def touched(spark: SparkSession, path: str, follower: str) -> tuple[list[str], list | None]:
    """Landings that a follower has not finished, and their dates; None if those are too many."""
    folder = f"{path}_touched/{follower}"
    if not exists(spark, folder):
        return [], []
    hadoop_path, fs = _path(spark, folder)
    landings = sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(hadoop_path))
    landings = [p for p in landings if exists(spark, f"{p}/_SUCCESS")]
    if not landings:
        return [], []
    if any(p.endswith(f"/{EVERYTHING}") for p in landings):
        return landings, None
    found = spark.read.parquet(*landings).distinct().limit(MAX_TOUCHED + 1).collect()
    return landings, None if len(found) > MAX_TOUCHED else sorted(r.event_date for r in found)


def days_of(spark: SparkSession, path: str, first: date) -> list[str]:
    """Dates of the folders ``day=...`` of a table from ``first`` on."""
    hadoop_path, fs = _path(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(n[4:] for n in names if n.startswith("day=") and n[4:] >= first.isoformat())


#: Where more than one in this many ids of a batch is repeated, all its rows are ordered at once.
ORDER_ALL = 10


def append_staged(batch: DataFrame, path: str) -> int:
    """Append the events of a written table whose id is new; returns the number of added rows.

    A raw table has one writer at a time, like a stream with its checkpoint. The dates of the batch
    are listed for the refresh jobs before and after the append: a job that takes the list in
    between finds it again, and a batch that is run again lists them anew. Only rows whose id stands
    several times in the batch are ordered by arrival, or all rows if there are many such ids; none
    are if no id is new, and the run of ids is empty then.
    """
    spark = batch.sparkSession
    landing = uuid.uuid4().hex
    ledger = Ledger(spark, path)
    ledger.recover(read_events(spark, path))
    counted = batch.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))
    with ExitStack() as stack:
        dates = stack.enter_context(staged(_dates(batch).coalesce(1), "dates"))
        _touch(dates, path, landing)
        ids = stack.enter_context(staged(counted, "ids"))
        known = stack.enter_context(staged(ledger.seen(ids), "known"))
        # A table of its own, so that its true size decides on a broadcast.
        twice = stack.enter_context(staged(ids.filter(F.col("copies") > 1).select("event_id"), "twice"))
        total = ids.count()
        added = total - known.count()
        if not added and exists(spark, path):
            fresh = spark.createDataFrame([], batch.schema)
        elif twice.count() * ORDER_ALL > total:
            fresh = first_per_event(batch).join(known, "event_id", "left_anti")
        else:
            fresh = first_of_repeated(batch.join(known, "event_id", "left_anti"), twice)
        pending = ledger.begin(fresh.select("event_id", utc_date(F.col("occurred_at")).alias("event_date")))
        columns = [field.name for field in schema.EVENTS_RAW]
        _write_events(_with_partitions(fresh.select(*columns)), path, "append")
        ledger.commit(pending)
        _touch(dates, path, landing)
        return added


def append_events(events: DataFrame, path: str) -> int:
    """Append events whose id is new, the first arrival wins; returns the number of added rows."""
    with staged(events, "append") as batch:
        return append_staged(batch, path)


def reset(spark: SparkSession, raw_path: str, retention_path: str, empty_retention: DataFrame):
    """Empty the raw events and publish an empty retention table."""
    remove(spark, raw_path)
    Ledger(spark, raw_path).clear()
    # The next refresh of either kind has to build everything.
    for follower in FOLLOWERS:
        spark.range(1).write.mode("overwrite").parquet(f"{raw_path}_touched/{follower}/{EVERYTHING}")
    publish(empty_retention, retention_path)


def _files_of(events: DataFrame, players: DataFrame) -> list[str]:
    """Files of stored events that hold events of the players; at most the files of the table."""
    held = events.select("player_id_hash", F.col("_metadata.file_path").alias("file"))
    found = held.join(players, "player_id_hash", "left_semi").select("file").distinct()
    return sorted(r.file for r in found.collect())


def purge_players(spark: SparkSession, path: str, players: DataFrame) -> tuple[int, int]:
    """Delete the stored events of ``player_id_hash`` rows; returns rewritten files and deleted events.

    Only files that hold such events are read as a whole and written anew. Their dates are listed
    for the refresh jobs, so derived tables follow. The ids stay in the ledger: an event that is sent
    again does not come back. The swap of files is planned in a folder beside the table first; a
    purge that fails is completed or undone by the next one. Like an append, it needs the table for
    itself, and readers of the raw table should not run meanwhile.
    """
    _finish_purge(spark, path)
    if not exists(spark, path):
        return 0, 0
    players = players.select("player_id_hash").distinct()
    files = _files_of(read_events(spark, path), players)
    if not files:
        return 0, 0
    held = spark.read.schema(schema.EVENTS_STORED).option("basePath", path).parquet(*files)
    gone = held.join(players, "player_id_hash", "left_semi")
    with staged(gone.select("event_id", "occurred_at"), "purge") as deleted:
        _touch(_dates(deleted), path, uuid.uuid4().hex)
        kept = held.join(players, "player_id_hash", "left_anti")
        _write_events(kept, f"{path}_purge/kept", "overwrite")
        spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}_purge/plan"
        )
        _finish_purge(spark, path)
        _touch(_dates(deleted), path, uuid.uuid4().hex)
        return len(files), deleted.count()


def _finish_purge(spark: SparkSession, path: str) -> None:
    """Swap the files of a planned purge. Each step may have been done already."""
    folder = f"{path}_purge"
    if exists(spark, f"{folder}/plan/_SUCCESS"):
        for r in spark.read.parquet(f"{folder}/plan").collect():
            remove(spark, r.file)
        kept, fs = _path(spark, f"{folder}/kept")
        for day in fs.listStatus(kept):
            if not day.isDirectory():
                continue
            for group in fs.listStatus(day.getPath()):
                target = f"{path}/{day.getPath().getName()}/{group.getPath().getName()}"
                fs.mkdirs(_path(spark, target)[0])
                for file in fs.listStatus(group.getPath()):
                    # A file name holds the id of its job: what is there is this very file.
                    fs.rename(file.getPath(), _path(spark, f"{target}/{file.getPath().getName()}")[0])
    remove(spark, folder)


def prune_raw(spark: SparkSession, path: str, as_of, days: int) -> list[str]:
    """Delete whole date partitions older than the retention period; returns their names."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    kept_from = (utc(as_of) - timedelta(days=days)).date()
    first_kept = kept_from.isoformat()
    ledger = Ledger(spark, path)
    ledger.recover(read_events(spark, path))
    dropped = []
    for status in fs.listStatus(hadoop_path):
        name = status.getPath().getName()
        if name.startswith("event_date=") and name.split("=")[1] < first_kept:
            fs.delete(status.getPath(), True)
            dropped.append(name)
    ledger.set_horizon(kept_from)
    return sorted(dropped)
