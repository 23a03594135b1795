"""Structured Streaming jobs.

The jobs that must be exact over all history (unique event ids, distinct players, replay windows)
use ``foreachBatch`` with the batch operators, so that stream and batch results are the same. Every
batch writes to places that only depend on the batch id or on the data, so a batch that is run again
after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from eventlens import fixed_values as fv
from eventlens import schema
from eventlens.config import Settings, use_utc
from eventlens.operators.daily import player_sessions, session_figures
from eventlens.operators.replay import replay_flags
from eventlens.operators.sessions import idle_times
from eventlens.plans.ingest import ingest
from eventlens.sources.batches import TEXT_OPTION, WITH_TEXT, marked_requests
from eventlens.sources.tables import MAX_TOUCHED, Scratch, exists, remove
from eventlens.streaming.stateful import _numbered

PLAYER_DAY = ("metric_date", "game_id", "player_id_hash")
PLAYER_DAY_SCHEMA = "metric_date date, game_id string, player_id_hash string"


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed request files as a stream."""
    reader = use_utc(spark).readStream.schema(WITH_TEXT).option(*TEXT_OPTION)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return marked_requests(reader.json(path))


def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_stream(
    requests: DataFrame,
    keys: DataFrame,
    raw_path: str,
    rejects_path: str,
    checkpoint: str,
    settings: Settings,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Continuous ingest: validation, first-wins dedupe against all stored events, append."""

    def land(batch: DataFrame, batch_no: int) -> None:
        ingest(batch, keys, raw_path, settings, rejects_path, batch_name=str(batch_no))

    return _start(requests.writeStream.foreachBatch(land), checkpoint, trigger)


def session_days_stream(
    spark: SparkSession,
    raw_path: str,
    target: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Session statistics per date and game, kept current as events land, also for late events.

    Sums are added up. A player counts once a date and game, so the job keeps the players it has
    counted by date; a batch looks up its own players there and appends the new ones. Neither stored
    events nor dates without new events are read. Read the result with ``session_days``.
    """
    landed = use_utc(spark).readStream.schema(schema.EVENTS_STORED).parquet(raw_path)
    players, totals = f"{target}/players", f"{target}/totals"

    def merge(batch: DataFrame, number: int) -> None:
        spark, scratch = batch.sparkSession, Scratch(batch.sparkSession, "session-days")
        made = scratch.write(player_sessions(batch))
        known = made.select(*PLAYER_DAY).limit(0)
        if exists(spark, players):
            # As literals the dates prune the partitions for sure; too many of them stay a join.
            days = [r.metric_date for r in made.select("metric_date").distinct().limit(MAX_TOUCHED + 1).collect()]
            counted = spark.read.schema(f"{PLAYER_DAY_SCHEMA}, batch bigint").parquet(players)
            if len(days) <= MAX_TOUCHED:
                counted = counted.filter(F.col("metric_date").isin(days))
            # A batch that is run again does not find the players it has written itself.
            counted = counted.filter(F.col("batch") < number).select(*PLAYER_DAY)
            known = counted.join(made.select(*PLAYER_DAY), list(PLAYER_DAY), "left_semi")
        marked = scratch.write(made.join(known.withColumn("known", F.lit(True)), list(PLAYER_DAY), "left"))
        (
            marked.filter("known is null").select(*PLAYER_DAY, F.lit(number).cast("bigint").alias("batch"))
            .hint("rebalance", "metric_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("metric_date", "batch")
            .parquet(players)
        )
        sums = marked.groupBy("metric_date", "game_id").agg(
            F.sum("sessions").alias("sessions"),
            F.count_if(F.col("known").isNull()).alias("players"),
            F.sum("length_sum").cast("decimal(38,6)").alias("length_sum"),
            F.sum("length_count").alias("length_count"),
        )
        before = _numbered(spark, totals, number)
        if before:
            sums = spark.read.parquet(f"{totals}/batch={before[-1]}").unionByName(sums).groupBy("metric_date", "game_id").agg(
                *[F.sum(c).cast(kind).alias(c) for c, kind in sums.dtypes[2:]]
            )
        sums.write.mode("overwrite").parquet(f"{totals}/batch={number}")
        scratch.clear()
        # The batch may be run again, which needs the sums before it, and no earlier ones.
        for old in before[:-1]:
            remove(spark, f"{totals}/batch={old}")

    return _start(landed.writeStream.foreachBatch(merge), checkpoint, trigger)


def session_days(spark: SparkSession, target: str) -> DataFrame:
    """The rows of ``session_stats`` that ``session_days_stream`` keeps."""
    folder = f"{target}/totals"
    return session_figures(spark.read.parquet(f"{folder}/batch={_numbered(spark, folder, 2**62)[-1]}"))


def idle_sessions(
    events: DataFrame,
    key: str = "player_id_hash",
    ts: str = "occurred_at",
    gap_s: int = fv.SESSION_IDLE_SECONDS,
    delay: str | None = None,
) -> DataFrame:
    """Sessions by idle time alone, for streams (with a ``delay`` for late events) and batches.

    A whole table is cut into ranges, so that a hot key is spread over many tasks. In a stream an
    idle time of exactly ``gap_s`` ends a session, and ``session_window`` would merge there, so its
    gap is one microsecond shorter.
    """
    if not events.isStreaming:
        return idle_times(events, key, ts, gap_s)
    source = events if delay is None else events.withWatermark(ts, delay)
    gap = f"{gap_s - 1} seconds 999999 microseconds"
    window = F.session_window(ts, gap)
    return source.groupBy(key, window.alias("session")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
    ).drop("session")


def replay_stream(
    requests: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    window_s: int,
    eligible: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Replay flags over a stream of requests with string ids, in order of arrival.

    The state is the set of open windows, the accepted requests of the last ``window_s`` seconds. It
    joins the next batch as its oldest requests, so the batch operator decides in both cases.
    """

    def flag(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        asked = eligible if eligible is not None else F.lit(True)
        incoming = batch.withColumns({"_open": F.lit(False), "_eligible": asked})
        before = f"{state}/batch={batch_no - 1}"
        if exists(spark, before):
            # A leading space sorts an open window before any request of the same instant.
            opened = spark.read.parquet(before).withColumn(
                "request_id", F.concat(F.lit(" "), F.ltrim("request_id"))
            )
            incoming = incoming.unionByName(opened, allowMissingColumns=True)
        scratch = Scratch(spark, "replay")
        flagged = replay_flags(incoming, window_s, F.col("_eligible"), scratch=scratch)
        result = f"{target}/batch={batch_no}"
        flagged.write.mode("overwrite").parquet(result)
        scratch.clear()

        written = spark.read.parquet(result)
        newest = written.agg(F.max("received_at")).scalar()
        accepted = written.filter("_eligible and not is_replay")
        still_open = F.col("received_at") > newest - F.make_dt_interval(secs=F.lit(window_s))
        (
            accepted.filter(still_open)
            .select(
                "request_id",
                "api_key_id",
                "nonce",
                "received_at",
                F.lit(True).alias("_open"),
                "_eligible",
            )
            .write.mode("overwrite")
            .parquet(f"{state}/batch={batch_no}")
        )
        # The batch may be run again, which needs the state before it, and no earlier one.
        remove(spark, f"{state}/batch={batch_no - 2}")

    return _start(requests.writeStream.foreachBatch(flag), checkpoint, trigger)


def replay_results(spark: SparkSession, target: str) -> DataFrame:
    """Flags of the requests of all batches."""
    return spark.read.parquet(target).filter("not _open").drop("_open", "_eligible", "batch")
