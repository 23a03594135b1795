"""Sessionisation, device tail budgets and batch packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventlens import fixed_values as fv
from eventlens.operators.sliced import SLICE, earlier_slices, in_ranges, per_slice, running_sums, spanning


def sessionize(
    events: DataFrame,
    key: str = "player_id_hash",
    ts: str = "occurred_at",
    tie: str = "event_id",
    gap_s: int = fv.SESSION_IDLE_SECONDS,
    start_event: str | None = "session_start",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``session_no`` (1, 2, ...) per key.

    A session begins at the first event of a key, at a start event, and after an idle time of at
    least ``gap_s`` seconds.
    """
    idle = gap_s * 1_000_000
    order = [F.col(ts), F.col(tie)]
    ordered = per_slice([key], order)
    at = F.unix_micros(ts)
    gap = at - F.lag(at).over(ordered)
    # The first row of a range has no gap here; the carried state decides about it. A key in a
    # single range begins with its first session.
    opens = (gap.isNotNull() & ((gap >= idle) | F.col("_start"))).cast("bigint").alias("_opens")

    start = F.col("event_name") == start_event if start_event else F.lit(False)
    sliced = in_ranges(events.withColumn("_start", start), [key], order, ranges)
    slices = (
        sliced.select(key, ts, tie, SLICE, "_start", opens)
        .groupBy(key, SLICE)
        .agg(
            F.sum("_opens").alias("_inner"),
            F.min(at).alias("_first_at"),
            F.max(at).alias("_last_at"),
            F.min_by("_start", F.struct(ts, tie)).alias("_first_start"),
        )
    )
    slices = spanning(slices, [key])
    idle_before = F.col("_first_at") - F.lag("_last_at").over(
        Window.partitionBy(key).orderBy(SLICE)
    )
    head = F.coalesce((idle_before >= idle) | F.col("_first_start"), F.lit(True)).cast("bigint")
    heads = slices.withColumn("_head", head)
    before = F.sum(F.col("_inner") + F.col("_head")).over(earlier_slices([key]))
    base = F.coalesce(before, F.lit(0)) + F.col("_head")
    carried = heads.select(key, SLICE, base.alias("_base"))

    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sliced.join(F.broadcast(carried), [key, SLICE], "left").select("*", opens)
    base = F.coalesce("_base", F.lit(1).cast("bigint"))
    return placed.select(*events.columns, (base + F.sum("_opens").over(so_far)).alias("session_no"))


def idle_times(
    events: DataFrame, key: str, ts: str, gap_s: int = fv.SESSION_IDLE_SECONDS
) -> DataFrame:
    """Sessions by idle time alone: events, first and last instant of each, from a whole table."""
    numbered = sessionize(events.select(key, ts), key, ts, ts, gap_s, start_event=None)
    return numbered.groupBy(key, "session_no").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
    ).drop("session_no")


def session_durations(
    sessions: DataFrame, key: str = "player_id_hash", ts: str = "occurred_at"
) -> DataFrame:
    """Events and whole seconds from first to last event per session."""
    first, last = F.min(F.unix_seconds(ts)), F.max(F.unix_seconds(ts))
    return sessions.groupBy(key, "session_no").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.greatest(last - first, F.lit(0)).alias("duration_s"),
    )


def tail_budget(
    events: DataFrame,
    key: str,
    body: str,
    ts: str = "occurred_at",
    tie: str = "event_id",
    max_rows: int = fv.DEVICE_TAIL_ROWS,
    max_bytes: int = fv.DEVICE_TAIL_BYTES,
    ranges: int | None = None,
) -> DataFrame:
    """Newest rows per key that fit both budgets; each body counts one byte for its line end.

    Both running figures only grow from newest to oldest, so the kept rows are exactly the ones
    that remain when the oldest are dropped one by one.
    """
    newest = [F.col(ts).desc(), F.col(tie).desc()]
    amounts = {
        "_rows": F.lit(1).cast("bigint"),
        "_bytes": (F.octet_length(body) + 1).cast("bigint"),
    }
    limits = {"_rows": max_rows, "_bytes": max_bytes}
    ranked = running_sums(in_ranges(events, [key], newest, ranges), [key], newest, amounts, limits)
    fits = (F.col("_rows") <= max_rows) & (F.col("_bytes") <= max_bytes)
    return ranked.filter(fits).select(*events.columns)


def pack_batches(
    events: DataFrame,
    key: str,
    ts: str = "occurred_at",
    tie: str = "event_id",
    size: int = fv.BATCH_MAX_EVENTS,
    ranges: int | None = None,
) -> DataFrame:
    """Number the events of a key in order and cut them into batches of ``size``."""
    oldest = [F.col(ts), F.col(tie)]
    counted = running_sums(in_ranges(events, [key], oldest, ranges), [key], oldest, {"_nth": F.lit(1).cast("bigint")})
    index = F.col("_nth") - 1
    return counted.select(
        *events.columns,
        F.call_function("div", index, F.lit(size)).alias("batch_no"),
        (index % size).cast("int").alias("position"),
    )
