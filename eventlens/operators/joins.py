"""Lookup joins on small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bytes of values, as text, up to which a dimension is broadcast.
LOOKUP_MAX_BYTES = 8 * 1024 * 1024


def with_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, max_bytes: int = LOOKUP_MAX_BYTES
) -> DataFrame:
    """Left join to a dimension such as the credentials, whose few keys hold very many rows each.

    The dimension is measured first. Within the bound it is broadcast, so that the rows are not
    shuffled onto a handful of keys. Beyond it, the join is left to the optimizer, which splits
    skewed keys at run time. A key that stands there twice is refused: it would multiply rows.
    """
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in lookup.columns]
    per_key = lookup.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(texts)).alias("size"))
    most, size = per_key.agg(F.max("n"), F.sum("size")).first()
    if (most or 0) > 1:
        raise ValueError(f"{key} is not unique in the lookup table")
    small = (size or 0) <= max_bytes
    return rows.join(F.broadcast(lookup) if small else lookup, key, "left")
