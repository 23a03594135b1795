"""Replay detection: a nonce may be used again only after its window has passed.

The first request of a nonce is accepted and opens a window. Requests inside it are replays and do
not extend it; the first request at or after its end is accepted and opens the next one. That is a
chain, but it needs no ordered pass over a nonce, so a nonce that holds a large share of the log is
no bottleneck:

1. requests are combined per nonce and millisecond in the map tasks;
2. a nonce whose requests span less than one window has one accepted request, its first;
3. the instants of the others are gathered by blocks of a few windows; a block with a full window of
   silence on both sides needs no other, so it is folded in its row;
4. of the blocks that touch others, an instant with a full window of silence before it is a sure
   start, and each instant is linked to the first instant a window later, per time slice;
5. what the sure starts reach over these links, up to the next sure start, is found by doubling the
   links, in as many rounds as the logarithm of the longest chain without such a silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.sources.tables import Scratch

NONCE = ["api_key_id", "nonce"]
#: Windows of a block, which bounds the instants that one row gathers.
BLOCK = 4


def _instants(requests: DataFrame, ts: str) -> DataFrame:
    return requests.groupBy(
        "api_key_id", F.lower("nonce").alias("nonce"), F.unix_millis(ts).alias("at")
    ).agg(F.min("request_id").alias("first_id"))


def _sliced(instants: DataFrame, window_ms: int) -> DataFrame:
    return instants.select(
        *NONCE, F.floor(F.col("at") / window_ms).cast("bigint").alias("slice"), "at"
    )


def sure_starts(instants: DataFrame, window_ms: int) -> DataFrame:
    """Instants without any other instant of their nonce in the window before them.

    A slice is one window long, so the instant before lies in the same slice or the one before, of
    which a copy is placed in the slice as history.
    """
    own = _sliced(instants, window_ms).withColumn("own", F.lit(True))
    history = own.withColumns({"slice": F.col("slice") + 1, "own": F.lit(False)})
    order = Window.partitionBy(*NONCE, "slice").orderBy("at")
    placed = own.unionByName(history).withColumn("before", F.lag("at").over(order))
    silent = F.col("before").isNull() | (F.col("at") - F.col("before") >= window_ms)
    return placed.filter(F.col("own") & silent).select(*NONCE, "at")


def next_window_start(instants: DataFrame, window_ms: int) -> DataFrame:
    """Link every instant to the first instant of its nonce that is a full window later.

    The target of an instant lies in the next slice of one window's length, or it is the first
    instant of a later slice, which comes from the summary of the slices.
    """
    none = F.lit(None).cast("bigint")
    points = _sliced(instants, window_ms).select(
        *NONCE, "slice", F.col("at").alias("position"), F.col("at").alias("event_at"), none.alias("origin")
    )
    probes = points.select(
        *NONCE,
        (F.col("slice") + 1).alias("slice"),
        (F.col("position") + window_ms).alias("position"),
        none.alias("event_at"),
        F.col("event_at").alias("origin"),
    )
    both = points.unionByName(probes)
    # Ordered backwards, so that the frames grow row by row.
    onward = (
        Window.partitionBy(*NONCE, "slice")
        .orderBy(F.desc("position"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = (
        Window.partitionBy(*NONCE)
        .orderBy(F.desc("slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = both.groupBy(*NONCE, "slice").agg(F.min("event_at").alias("first_at"))
    carried = firsts.select(*NONCE, "slice", F.min("first_at").over(later).alias("later_at"))
    found = both.withColumn("here_at", F.min("event_at").over(onward)).filter("origin is not null")
    linked = found.join(carried, [*NONCE, "slice"])
    return linked.select(
        *NONCE, F.col("origin").alias("at"), F.coalesce("here_at", "later_at").alias("next_at")
    ).filter("next_at is not null")


def _window_starts(instants: DataFrame, window_ms: int, scratch: Scratch) -> DataFrame:
    """All instants that open a window."""
    starts = scratch.write(sure_starts(instants, window_ms))
    ends = starts.withColumnRenamed("at", "next_at")
    links = next_window_start(instants, window_ms).join(ends, [*NONCE, "next_at"], "left_anti")
    links = scratch.write(links)
    reached = starts
    while True:
        further = reached.join(links, [*NONCE, "at"]).select(*NONCE, F.col("next_at").alias("at"))
        further = scratch.write(further)
        if further.isEmpty():
            return reached
        # After n rounds the first 2^n instants of every chain are reached, each exactly once.
        reached = reached.unionByName(further)
        beyond = links.select(*NONCE, F.col("at").alias("next_at"), F.col("next_at").alias("far_at"))
        doubled = links.join(beyond, [*NONCE, "next_at"])
        links = scratch.write(doubled.select(*NONCE, "at", F.col("far_at").alias("next_at")))


def _blocks(instants: DataFrame) -> DataFrame:
    """First and last instant of every nonce and block of ``BLOCK`` windows."""
    return instants.groupBy(*NONCE, "_block").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("first_id", "at").alias("first_id")
    )


def _touching(blocks: DataFrame, window_ms: int) -> DataFrame:
    """Blocks with an instant less than a window away from one of an earlier or later block.

    A block is longer than a window, so only the next one can be touched, and only by an instant
    less than a window from the edge.
    """
    edge = (F.col("_block") + 1) * (BLOCK * window_ms)
    reaching = blocks.filter(edge - F.col("last_at") < window_ms).select(
        *NONCE, (F.col("_block") + 1).alias("_block"), F.col("last_at").alias("_before")
    )
    touched = blocks.join(reaching, [*NONCE, "_block"]).filter(F.col("first_at") - F.col("_before") < window_ms)
    both = F.explode(F.array(F.col("_block") - 1, F.col("_block"))).alias("_block")
    return touched.select(*NONCE, both).distinct()


def _folded(instants: Column, window_ms: int) -> Column:
    """The instants of an ordered list that open a window, from the first on."""
    none = F.filter(instants, lambda _: F.lit(False))
    return F.aggregate(
        instants,
        none,
        lambda opened, x: F.when(
            (F.size(opened) == 0) | (x["at"] - F.element_at(opened, -1)["at"] >= window_ms), F.concat(opened, F.array(x))
        ).otherwise(opened),
    )


def accepted_ids(
    requests: DataFrame, window_s: int, ts: str = "received_at", scratch: Scratch | None = None
) -> DataFrame:
    """Ids of the requests that open a window, as a written table.

    All other tables that are written on the way are removed. With a ``scratch`` the caller can
    remove the result too, once it is used.
    """
    scratch = scratch or Scratch(requests.sparkSession, "replay")
    found = scratch.write(_accepted(requests, window_s, ts, scratch))
    scratch.clear(keep=1)
    return found


def _accepted(requests: DataFrame, window_s: int, ts: str, scratch: Scratch) -> DataFrame:
    window_ms = window_s * 1000
    # Read four times below; written once, it is narrow and has a known size.
    instants = scratch.write(_instants(requests, ts))
    spans = instants.groupBy(*NONCE).agg(
        F.min("at").alias("at"),
        F.max("at").alias("last_at"),
        F.min_by("first_id", "at").alias("request_id"),
    )
    reused = F.col("last_at") - F.col("at") >= window_ms
    long = scratch.write(spans.filter(reused).select(*NONCE))
    if long.isEmpty():
        return spans.select("request_id")
    single = spans.filter(~reused).select("request_id")
    block = F.floor(F.col("at") / (BLOCK * window_ms)).cast("bigint")
    chains = instants.join(long, NONCE, "left_semi").filter("at is not null").withColumn("_block", block)
    blocks = scratch.write(_blocks(chains))
    touching = scratch.write(_touching(blocks, window_ms))
    place = [*NONCE, "_block"]
    alone = blocks.join(touching, place, "left_anti")
    several = F.col("last_at") - F.col("first_at") >= window_ms
    gathered = (
        chains.join(alone.filter(several).select(*place), place, "left_semi")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.struct("at", "first_id"))).alias("_instants"))
    )
    folded = gathered.select(F.inline(_folded(F.col("_instants"), window_ms)))
    found = reduce(
        DataFrame.unionByName,
        [single, *[part.select(F.col("first_id").alias("request_id")) for part in (alone.filter(~several), folded)]],
    )
    if touching.isEmpty():
        return found
    linked = scratch.write(chains.join(touching, place, "left_semi").drop("_block"))
    starts = _window_starts(linked, window_ms, scratch)
    again = linked.join(starts, [*NONCE, "at"]).select(F.col("first_id").alias("request_id"))
    return found.unionByName(again)


def replay_flags(
    requests: DataFrame,
    window_s: int,
    eligible: Column | None = None,
    ts: str = "received_at",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``is_replay``. Only eligible requests (valid time and signature) are registered."""
    counted = eligible if eligible is not None else F.lit(True)
    registered = requests.filter(counted)
    accepted = accepted_ids(registered, window_s, ts, scratch).withColumn("_accepted", F.lit(True))
    joined = requests.join(accepted, "request_id", "left")
    return joined.withColumn("is_replay", counted & F.col("_accepted").isNull()).drop("_accepted")
