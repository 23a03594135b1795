"""The ids of all stored events, kept beside the raw table for the check at every append.

The ledger is a set of runs. A run holds the ids of one append, or of several that were merged, in
folders by hash bucket, sorted, with Parquet Bloom filters and small row groups. An append reads the
buckets of its own ids only; with few ids it gives them to the scan as literals, so that row groups
without any of them are skipped by statistics and Bloom filters. ``MERGED`` runs of a size become one,
so an id is written anew as often as the logarithm of the number of appends.

An append first writes its new ids as a pending run, then the events, and then renames the run. A
pending run that is found later belongs to an append that failed; its ids are looked up among the
stored events of its dates, and those that are there become a run.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 16
#: Ids that are given to a scan as literals; more are joined bucket by bucket.
LITERAL_IDS = 2_000
#: Runs of one level that are merged into one of the next.
MERGED = 8
#: Bytes of a row group, and of a page: what a lookup reads for an id that may be there.
ROW_GROUP, PAGE = 4 << 20, 64 << 10

_RUN = re.compile(r"^run=(\d{12})-(\d{12})$")
_HORIZON = re.compile(r"^horizon=(\d{4}-\d{2}-\d{2})$")
_SCHEMA = "event_id string, event_date date, bucket int"
_IN_LIST = "spark.sql.parquet.pushdown.inFilterThreshold"


def bucket(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int")


class Ledger:
    """The ledger of the raw table at ``raw``. A raw table has one writer at a time."""

    def __init__(self, spark: SparkSession, raw: str):
        self.spark, self.raw, self.path = spark, raw, f"{raw}_ids"

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path, fs = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        path, fs = self._fs(f"{self.path}/{name}")
        fs.delete(path, True)

    def _rename(self, name: str, other: str) -> None:
        (old, fs), (new, _) = self._fs(f"{self.path}/{name}"), self._fs(f"{self.path}/{other}")
        if not fs.rename(old, new):
            raise RuntimeError(f"cannot rename {old} to {new}")

    def runs(self) -> list[tuple[int, int]]:
        """First and last append of each run; runs inside a merged one no longer count."""
        found = [tuple(map(int, m.groups())) for m in map(_RUN.match, self._names()) if m]
        return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]

    def horizon(self) -> date | None:
        """Ids of events before this date no longer count: their events were deleted."""
        found = [date.fromisoformat(m[1]) for m in map(_HORIZON.match, self._names()) if m]
        return max(found, default=None)

    def set_horizon(self, day: date) -> None:
        path, fs = self._fs(f"{self.path}/horizon={day.isoformat()}")
        fs.mkdirs(path)

    def clear(self) -> None:
        path, fs = self._fs(self.path)
        fs.delete(path, True)

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _SCHEMA)
        paths = [f"{self.path}/run={a:012d}-{b:012d}" for a, b in runs]
        ids = self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*paths).drop("run")
        horizon = self.horizon()
        return ids if horizon is None else ids.filter(F.col("event_date") >= F.lit(horizon))

    def _write(self, ids: DataFrame, name: str) -> None:
        """One sorted file per bucket that has ids."""
        (
            ids.select("event_id", "event_date", bucket(F.col("event_id")).alias("bucket"))
            .repartition("bucket")
            .sortWithinPartitions("bucket", "event_id")
            .write.mode("overwrite")
            .option("parquet.block.size", ROW_GROUP)
            .option("parquet.page.size", PAGE)
            .option("parquet.bloom.filter.enabled#event_id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy("bucket")
            .parquet(f"{self.path}/{name}")
        )

    def seen(self, ids: DataFrame) -> DataFrame:
        """Those of the distinct ids ``event_id`` that are stored.

        At most ``BUCKETS`` bucket numbers and ``LITERAL_IDS`` ids come to the driver.
        """
        runs = self.runs()
        if not runs:
            return ids.select("event_id").limit(0)
        stored = self._read(runs)
        few = [r.event_id for r in ids.select("event_id").limit(LITERAL_IDS + 1).collect()]
        if len(few) <= LITERAL_IDS:
            # Beyond this number Parquet would get the least and largest id alone.
            if int(self.spark.conf.get(_IN_LIST)) < LITERAL_IDS:
                self.spark.conf.set(_IN_LIST, str(LITERAL_IDS))
            made = self.spark.createDataFrame([(i,) for i in few], "event_id string")
            touched = [r.b for r in made.select(bucket(F.col("event_id")).alias("b")).distinct().collect()]
            found = stored.filter(F.col("bucket").isin(touched) & F.col("event_id").isin(few))
            return found.select("event_id").distinct()
        placed = ids.select("event_id", bucket(F.col("event_id")).alias("bucket"))
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
        held = stored.filter(F.col("bucket").isin(touched))
        return held.join(placed, ["bucket", "event_id"], "left_semi").select("event_id").distinct()

    def begin(self, ids: DataFrame) -> str:
        """Write ``event_id, event_date`` of an append as a pending run; returns its name."""
        runs = self.runs()
        name = f"pending={max((b for _, b in runs), default=0) + 1:012d}"
        self._write(ids, name)
        return name

    def commit(self, pending: str) -> None:
        number = pending.split("=")[1]
        self._rename(pending, f"run={number}-{number}")
        self._merge()

    def recover(self, stored: DataFrame) -> None:
        """Settle what a failed append has left; without a ledger, list all stored ids."""
        names = self._names()
        if not names:
            ids = stored.select("event_id", "event_date")
            if ids.limit(1).count():
                self.commit(self.begin(ids))
            return
        for name in names:
            if name.startswith("building="):
                self._remove(name)
            if not name.startswith("pending="):
                continue
            path, fs = self._fs(f"{self.path}/{name}/_SUCCESS")
            if fs.exists(path):  # otherwise no event was written yet
                ids = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{name}")
                dates = ids.select("event_date").distinct()
                there = stored.join(F.broadcast(dates), "event_date", "left_semi").select("event_id")
                building = f"building={name.split('=')[1]}"
                self._write(ids.join(there, "event_id", "left_semi"), building)
                self._remove(name)
                number = name.split("=")[1]
                self._rename(building, f"run={number}-{number}")
            else:
                self._remove(name)

    def _merge(self) -> None:
        """Merge the newest runs as long as ``MERGED`` of one level stand at the end."""
        while True:
            runs = self.runs()
            for name in self._names():  # runs that a merged one holds
                m = _RUN.match(name)
                if m and tuple(map(int, m.groups())) not in runs:
                    self._remove(name)
            last = runs[-MERGED:]
            if len(last) < MERGED or len({self._level(r) for r in last}) > 1:
                return
            target = f"{last[0][0]:012d}-{last[-1][1]:012d}"
            self._write(self._read(last), f"building={target}")
            self._rename(f"building={target}", f"run={target}")

    @staticmethod
    def _level(run: tuple[int, int]) -> int:
        level, length = 0, run[1] - run[0] + 1
        while length >= MERGED:
            level, length = level + 1, length // MERGED
        return level
