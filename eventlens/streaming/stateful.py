"""Streams with state per key: numbered sessions, replay windows, unpaired match ends, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventlens import fixed_values as fv
from eventlens.operators.filters import named
from eventlens.operators.requests import alerts_of_cells, minute_cells
from eventlens.sources.tables import Scratch, exists

_SESSION_STATE = "session_no long, last_us long, at array<long>, tie array<string>, opens array<boolean>"


def numbered_sessions(
    events: DataFrame,
    delay: str,
    key: str = "player_id_hash",
    ts: str = "occurred_at",
    tie: str = "event_id",
    gap_s: int = fv.SESSION_IDLE_SECONDS,
    start_event: str | None = "session_start",
) -> DataFrame:
    """``sessionize`` over a stream: key, instant, tie and ``session_no`` of every event.

    Events may arrive out of order by ``delay``. They wait in the state of their key until the
    watermark has passed them, when nothing can come before them any more, and are then numbered in
    order; events behind the watermark are dropped. A key keeps its last number and instant, and
    what has arrived within the delay.
    """
    idle = gap_s * 1_000_000

    def number(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, [], [], [])
        no, last, waiting = held[0], held[1], list(zip(*(list(x) for x in held[2:])))
        for frame in frames:
            waiting += zip(frame["us"].tolist(), frame["tie"].tolist(), frame["opens"].tolist())
        waiting.sort()
        upto = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in waiting if x[0] <= upto]
        rest = waiting[len(ready) :]
        out = []
        for at, event, opens in ready:
            if not no or opens or at - last >= idle:
                no += 1
            last = at
            out.append((name[0], at, event, no))
        state.update((no, last, *([list(x) for x in zip(*rest)] or [[], [], []])))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "tie", "session_no"])

    opens = F.coalesce(F.col("event_name") == start_event, F.lit(False)) if start_event else F.lit(False)
    narrow = events.withWatermark(ts, delay).select(
        F.col(key).alias("key"), ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("string").alias("tie"), opens.alias("opens")
    )
    numbered = narrow.groupBy("key").applyInPandasWithState(
        number, "key string, us long, tie string, session_no long", _SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return numbered.select(
        F.col("key").alias(key), F.timestamp_micros("us").alias(ts), F.col("tie").alias(tie), "session_no"
    )


def replay_windows(
    requests: DataFrame, window_s: int, delay: str, eligible: Column | None = None, ts: str = "received_at"
) -> DataFrame:
    """``request_id, is_replay`` of a stream of requests, in order of arrival.

    The state of a key and nonce is the instant of its accepted request. It leaves when the
    watermark has passed the end of its window, so the state holds the nonces of the last
    ``window_s`` seconds and of the delay. Requests later than the delay are dropped.
    """
    window_ms = window_s * 1000

    def flag(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened = state.get[0] if state.exists else None
        arrived = pd.concat(list(frames)).sort_values(["at", "request_id"])
        flags = []
        for at, asked in zip(arrived["at"].tolist(), arrived["asked"].tolist()):
            again = bool(asked) and opened is not None and at - opened < window_ms
            if asked and not again:
                opened = at
            flags.append(again)
        if opened is not None:
            state.update((opened,))
            state.setTimeoutTimestamp(max(opened + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": arrived["request_id"], "is_replay": flags})

    asked = F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False))
    narrow = requests.withWatermark(ts, delay).select(
        ts, "api_key_id", F.lower("nonce").alias("nonce"), "request_id", F.unix_millis(ts).alias("at"), asked.alias("asked")
    )
    return narrow.groupBy("api_key_id", "nonce").applyInPandasWithState(
        flag, "request_id string, is_replay boolean", "opened long", "append", GroupStateTimeout.EventTimeTimeout
    )


def orphan_stream(events: DataFrame, match_id: Column, delay: str, within: str) -> DataFrame:
    """``match_end`` events of a stream without a ``match_start`` of the match up to ``within`` before.

    A stream has to let go of starts at some time, so a match has a greatest length here. An end is
    reported once the watermarks of both sides have passed it.
    """
    ids = events.withColumn("_match", match_id)
    starts = named(ids, "match_start").select(F.col("_match").alias("_start_match"), F.col("occurred_at").alias("_started"))
    ends = named(ids, "match_end").withWatermark("occurred_at", delay)
    earlier = (F.col("_started") <= F.col("occurred_at")) & (F.col("_started") >= F.col("occurred_at") - F.expr(f"interval {within}"))
    paired = ends.join(
        starts.withWatermark("_started", delay), (F.col("_match") == F.col("_start_match")) & earlier, "left_outer"
    )
    return paired.filter(F.col("_started").isNull()).select(*events.columns)


def _numbered(spark: SparkSession, folder: str, before: int) -> list[int]:
    """Numbers of the complete states ``batch=N`` below ``before``."""
    if not exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [n for n in numbers if n < before and exists(spark, f"{folder}/batch={n}/_SUCCESS")]


def alert_stream(
    log: DataFrame, target: str, checkpoint: str, delay: str, rules: tuple = fv.SERVICE_ALERTS, trigger: dict | None = None
) -> StreamingQuery:
    """Counts per service and minute of a request log, kept current for ``live_alerts``.

    The counts are a windowed aggregation with a watermark. Each batch gives the minutes that have
    changed with their whole counts, and replaces their rows in a table by month; only months with a
    change are read and written. A batch that is run again writes the same rows.
    """
    cells = minute_cells(log.withWatermark("received_at", delay), rules, F.window("received_at", "1 minute").start)

    def upsert(changed: DataFrame, _: int) -> None:
        spark = changed.sparkSession
        scratch = Scratch(spark, "alerts")
        made = scratch.write(changed.withColumn("month", F.date_format("minute", "yyyy-MM")))
        months = [r.month for r in made.select("month").distinct().collect()]  # of one batch: few
        if exists(spark, target):
            stored = spark.read.schema(made.schema).parquet(target).filter(F.col("month").isin(months))
            kept = stored.join(made.select("service", "minute"), ["service", "minute"], "left_anti")
            made = scratch.write(kept.unionByName(made))
        made.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(target)
        scratch.clear()

    writer = cells.writeStream.outputMode("update").foreachBatch(upsert)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_alerts(spark: SparkSession, target: str, rules: tuple = fv.SERVICE_ALERTS) -> DataFrame:
    """``service_alerts`` of the counts that ``alert_stream`` keeps."""
    return alerts_of_cells(spark.read.parquet(target).drop("month"), rules)
