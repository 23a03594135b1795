"""Ordered computations per key that stay parallel when one key dominates.

A window over a key puts all rows of that key into one task. Here the rows are dealt by range of
key and order into partitions of equal size, so a key with a third of all rows, even within one
hour, is spread over a third of the tasks. The window runs per key and range, and what earlier
ranges contribute is carried over from a summary of the keys that lie in more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.sources.tables import cut

SLICE = "_slice"


def in_ranges(
    df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None
) -> DataFrame:
    """Add the number of the range that a row lies in; ranges follow the keys and then ``order``.

    The bounds are sampled, so the rows are written once, by a reliable checkpoint: every later
    read sees the same ranges. Their number is that of shuffle partitions unless given.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*([] if ranges is None else [ranges]), *by)
    return cut(placed.withColumn(SLICE, F.spark_partition_id()))


def per_slice(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def earlier_slices(keys: list[str]) -> Window:
    """All ranges of the key before the current one."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def spanning(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a summary by key and range whose key lies in several ranges.

    Ranges are contiguous, so at most one key goes on from a range to the next: there are fewer than
    twice as many rows as ranges, which makes the result fit for broadcasting at any scale.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return summary.withColumn("_ranges", several).filter("_ranges > 1").drop("_ranges")


def carried_sums(df: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Per spanning key and range, the sum of each amount over all earlier ranges as
    ``<name>_before``."""
    sums = df.groupBy(*keys, SLICE).agg(*[F.sum(a).alias(name) for name, a in amounts.items()])
    before = earlier_slices(keys)
    return spanning(sums, keys).select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in amounts],
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    amounts: dict[str, Column],
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """Add the running sum of each amount in ``order`` within the key; needs ``in_ranges``.

    With ``limits`` for positive amounts, ranges that begin at or beyond a limit are left out, which
    drops their rows before the window.
    """
    carried = carried_sums(df, keys, amounts)
    placed = df.join(F.broadcast(carried), [*keys, SLICE], "left")
    zero = F.lit(0).cast("bigint")
    placed = placed.withColumns({f"{n}_before": F.coalesce(f"{n}_before", zero) for n in amounts})
    for name, limit in (limits or {}).items():
        placed = placed.filter(F.col(f"{name}_before") < limit)
    window = per_slice(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        *df.columns,
        *[
            (F.col(f"{name}_before") + F.sum(amount).over(window)).alias(name)
            for name, amount in amounts.items()
        ],
    )
