"""First-wins dedupe on the event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


ARRIVAL = ("received_at", "batch_id", "position")


def first_per_event(events: DataFrame, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """One row per event_id, the one that arrived first, by the arrival columns that are there.

    Filtering ``row_number() = 1`` lets Spark keep one row per id in each map task before the
    shuffle, so any number of copies of one event costs at most one row per task. Ties are broken
    by all other columns, which makes reruns agree.
    """
    given = [c for c in order if c in events.columns]
    rest = sorted(set(events.columns) - set(given) - {"event_id"})
    arrival = Window.partitionBy("event_id").orderBy(*given, *rest)
    ranked = events.withColumn("_arrival", F.row_number().over(arrival))
    return ranked.filter("_arrival = 1").drop("_arrival")


def first_of_repeated(
    events: DataFrame, repeated: DataFrame, order: tuple[str, ...] = ARRIVAL
) -> DataFrame:
    """``first_per_event``, given the frame of all ids that stand on several rows.

    Only the rows of these ids are shuffled and ordered; the others stay where they are. A null id
    is an id like any other.
    """
    names = repeated.select(F.col("event_id").alias("_repeated"))
    same = F.col("event_id").eqNullSafe(F.col("_repeated"))
    once = events.join(names, same, "left_anti")
    return once.unionByName(first_per_event(events.join(names, same, "left_semi"), order))
