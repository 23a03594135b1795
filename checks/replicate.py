"""A larger copy of the events for scale runs: ``python -m checks.replicate <sf_dir> <n> <out>``.

Every copy gets its own ids and players, so counts grow with ``n``; every third event belongs to one
player, so that one key holds a third of all rows.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F


def main() -> None:
    from bench import session

    sf_dir, n, out = sys.argv[1], int(sys.argv[2]), sys.argv[3]
    spark = session("8")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hot = F.pmod(F.xxhash64("event_id", "copy"), F.lit(3)) == 0
    grown = copies.select(
        (F.col("event_id") + F.col("copy") * 10_000_000).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("copy") * F.lit(0.007919))).alias("ts"),
        F.when(hot, 1).otherwise(F.col("user_id") + F.col("copy") * 1_000_000).alias("user_id"),
        "event_type",
        "value",
        "props",
    )
    grown.repartition(32).write.parquet(f"{out}/events.parquet")
    for other in Path(sf_dir).glob("*.parquet"):
        if other.name != "events.parquet":
            spark.read.parquet(str(other)).write.parquet(f"{out}/{other.name}")


if __name__ == "__main__":
    main()
