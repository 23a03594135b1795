"""Mixing sources to target weights by Poisson replication.

Each group of documents gets a mean repetition rate, each document a hash-seeded Poisson number of
copies with that mean, and the copies are shuffled over the whole output.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import free_name

#: A mean is split into equal parts of at most this much, each inverted with its own hash.
PART = 8.0
BITS = 52


def thresholds(mean: float) -> list[float]:
    """Cumulative Poisson probabilities up to the last that a hash of ``BITS`` bits can reach."""
    out, k, p = [], 0, math.exp(-mean)
    total = p
    while total < 1 - 2.0**-BITS and k < 200:
        out.append(total)
        k += 1
        p *= mean / k
        total += p
    return out


def rates(sizes: Mapping[str | None, float], weights: Mapping[str, float], epochs: float) -> dict:
    """Mean repetitions by group: target share of the output over the group's share of the input.

    ``weights`` are the shares of named sources; what they leave of 1 goes to all others together
    (key None). A group without any rows has rate 0, and the shares of the others stay as they are.
    """
    rest = 1.0 - sum(weights.values())
    if rest < -1e-9 or min(weights.values(), default=0.0) < 0:
        raise ValueError("target weights must be at least 0 and add up to 1 at most")
    target = {**weights, None: max(0.0, rest)}
    total = sum(sizes.values())
    return {g: (epochs * w * total / sizes[g] if sizes.get(g) else 0.0) for g, w in target.items()}


def uniform(seed: str, *parts: Column) -> Column:
    """A hash in [0, 1) of ``BITS`` bits."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") / float(2**BITS)


def copies(mean: float, seed: str, key: Column) -> Column:
    """Poisson numbers of copies: the sum of equal parts, each by inversion of a hash."""
    if mean <= 0:
        return F.lit(0)
    parts = math.ceil(mean / PART)
    steps = F.array(*[F.lit(t) for t in thresholds(mean / parts)])

    def one(i: Column) -> Column:
        return F.transform(
            F.array(uniform(seed, key, i)), lambda u: F.size(F.filter(steps, lambda t: t <= u))
        )[0]

    if parts == 1:
        return one(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda a, i: a + one(i))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    epochs: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Replicate documents so that named sources reach their target shares of all characters.

    The output has the columns of the input, then the copy's number from 0 (``copy``) and a random
    key (``shuffle_key``): partitions are dealt by the key and sorted by it, a global permutation.

    ``weights`` maps sources to shares; all other sources, null among them, share the rest in
    proportion to their size. So the statistics have one row per named source and one for the rest,
    however many sources there are. A null text has size 0. Equal rows get equal numbers of copies,
    a null id is an id of its own. A source without characters gets no copies; an empty table gives
    an empty table. The number of copies depends on id, seed and rate only, so a lost task is
    repeated with the same result.
    """
    group = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    size = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")
    sums = docs.groupBy(group.alias("g")).agg(F.sum(size).alias("n")).collect()
    rate = rates({r["g"]: r["n"] for r in sums}, weights, epochs)
    count = F.lit(None)
    for name, mean in rate.items():
        is_it = group.isNull() if name is None else group == F.lit(name)
        count = F.when(is_it, copies(mean, seed, F.col(id_col))).otherwise(count)
    n, copy = free_name(docs.columns, "n_copies"), free_name(docs.columns, "copy")
    key = free_name(docs.columns, "shuffle_key")
    dealt = (
        docs.withColumn(n, count)
        .where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        .drop(n)
        .withColumn(key, F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.col(copy).cast("string"))))
    )
    return dealt.repartition(F.col(key)).sortWithinPartitions(key)
