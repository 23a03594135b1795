"""Hard negatives by an STR-packed R-tree.

Rows are dealt into shards by sort-tile-recursive packing: by label, slices of the widest coordinate
and the second one. A shard packs its rows in the same way into pages of one label, and nodes over
the pages. The box of a node bounds the inner product with a query coordinate by coordinate. A
query goes to the shards that its bounds allow, and there takes nodes best first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import cut

#: Rows of a shard, of a page, and children of a node. Shards are at most ``MAX_SHARDS``, so that
#: their boxes can be broadcast (two vectors each); beyond, shards grow.
SHARD_ROWS, MAX_SHARDS = 16_384, 4_096
PAGE, FANOUT = 256, 16
#: Queries that one task takes to a shard; more are dealt to further tasks.
QUERY_ROWS = 20_000
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this many hundredths of the positive's, and at most the same.
LEAST_PERCENT = 80


def usable(label: Column, vec: Column) -> Column:
    """The label and every component are there, and the components are finite."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(label.isNotNull() & vec.isNotNull() & finite, F.lit(False))


def quantised(vec: Column, factor: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def _stack(vectors, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _packed(points: np.ndarray, size: int, dims: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive: slabs of the first dimension, tiles of the others inside, ``size`` rows each."""

    def tile(rows: np.ndarray, left: list[int]) -> Iterator[np.ndarray]:
        rows = rows[np.argsort(points[rows, left[0]], kind="stable")]
        pages = -(-len(rows) // size)
        if len(left) == 1 or pages == 1:
            yield from (rows[i : i + size] for i in range(0, len(rows), size))
            return
        slab = size * math.ceil(pages / math.ceil(pages ** (1 / len(left))))
        for i in range(0, len(rows), slab):
            yield from tile(rows[i : i + slab], left[1:])

    return list(tile(np.arange(len(points)), dims)) if len(points) else []


_PAGE = "shard int, label bigint, ids array<bigint>, vecs array<double>, lo array<double>, hi array<double>"


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """Pages of the rows ``id, label, vec`` as a checkpointed table, and the width of the vectors."""
    size = F.max(F.size("vec"))
    n, width = rows.agg(F.count(F.lit(1)), size).first()
    width = width if n and width > 0 else 1
    at = [F.coalesce(F.get("vec", F.lit(k)), F.lit(0.0)) for k in range(width)]
    spread = rows.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in at]).first()
    dims = [int(k) for k in np.argsort(-np.nan_to_num(np.array([float(x) for x in spread])), kind="stable")[:4]]
    shards = min(MAX_SHARDS, -(-max(n, 1) // SHARD_ROWS))
    slabs = max(1, math.isqrt(shards))
    first, second = at[dims[0]], at[dims[-1] if len(dims) < 2 else dims[1]]
    edges = rows.agg(F.percentile_approx(first, [k / slabs for k in range(1, slabs)], 10_000)).first()[0] if slabs > 1 else []
    slab = sum(((first > e).cast("int") for e in edges or []), F.lit(0))
    dealt = rows.select("id", "label", "vec", slab.alias("s"), second.alias("c"))
    # The id parts rows that agree in all else, so one value cannot fill a shard.
    dealt = dealt.repartitionByRange(shards, "label", "s", "c", "id").select(
        F.spark_partition_id().alias("shard"), "id", "label", "vec"
    )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames), ignore_index=True)
        for label, part in whole.groupby("label", sort=True):
            part = part.sort_values("id", kind="stable")
            points, ids = _stack(part["vec"].tolist(), width), part["id"].to_numpy()
            pages = _packed(points, PAGE, dims)
            yield pd.DataFrame({
                "shard": part["shard"].iloc[0], "label": label,
                "ids": [ids[p] for p in pages], "vecs": [points[p].ravel() for p in pages],
                "lo": [points[p].min(0) for p in pages], "hi": [points[p].max(0) for p in pages],
            })

    def guarded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [f for f in frames if len(f)]
        if kept:
            yield from pack(iter(kept))

    return cut(dealt.mapInPandas(guarded, _PAGE)), width


class Tree:
    """The nodes over the pages of one label in a shard; level 0 are the pages."""

    def __init__(self, ids: list[np.ndarray], vecs: list[np.ndarray], lo: np.ndarray, hi: np.ndarray):
        self.ids, self.vecs = ids, vecs
        self.levels = [(lo, hi)]
        while len(self.levels[-1][0]) > FANOUT:
            lo, hi = self.levels[-1]
            cuts = range(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)))

    def search(self, q: np.ndarray, windows: Windows, own: int) -> None:
        """Add the highest rows of each window, best nodes first."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        queue: list[tuple] = []

        def push(level: int, start: int, stop: int) -> None:
            lo, hi = (x[start:stop] for x in self.levels[level])
            low, high = lo @ up + hi @ down, hi @ up + lo @ down
            value = windows.value(low, high)
            for k in np.flatnonzero(value > -np.inf):
                heapq.heappush(queue, (-value[k], level, start + int(k), low[k : k + 1], high[k : k + 1]))

        top = len(self.levels) - 1
        push(top, 0, len(self.levels[top][0]))
        while queue:
            _, level, k, low, high = heapq.heappop(queue)
            if windows.value(low, high)[0] == -np.inf:
                continue
            if level:
                push(level - 1, k * FANOUT, min(len(self.levels[level - 1][0]), (k + 1) * FANOUT))
            else:
                windows.add(self.vecs[k] @ q, self.ids[k], own)


class Windows:
    """Score windows of a query (bounds in hundredths), each with its best rows so far."""

    def __init__(self, least, most, size: int):
        self.least, self.most, self.size = np.asarray(least), np.asarray(most), size
        self.heaps: list[list[tuple]] = [[] for _ in self.least]  # (score, -id), the worst first
        self.kth = np.full(len(self.least), -np.inf)

    def value(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The best score that each box can add; minus infinity outside all windows, or strictly
        below the kth of those it meets (an equal score may have a smaller id)."""
        low, high = low[:, None], high[:, None]
        meets = (100 * high >= self.least) & (100 * low <= self.most) & (high >= self.kth)
        return np.where(meets, np.minimum(high, self.most / 100), -np.inf).max(1)

    def add(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        column = scores[:, None]
        fits = (100 * column >= self.least) & (100 * column <= self.most) & (column >= self.kth) & (ids != own)[:, None]
        for w in np.flatnonzero(fits.any(0)):
            rows = np.flatnonzero(fits[:, w])
            if len(rows) > self.size:
                rows = rows[np.lexsort((ids[rows], -scores[rows]))[: self.size]]
            heap = self.heaps[w]
            for row in zip(scores[rows].tolist(), (-ids[rows]).tolist()):
                if len(heap) < self.size:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
            if len(heap) == self.size:
                self.kth[w] = heap[0][0]


_FOUND = "id bigint, w int, other bigint, score double"
_QUERY = "shard int, part int, id bigint, label bigint, vec array<double>, low array<double>, high array<double>"


def _search(pages: DataFrame, queries: DataFrame, width: int, same: bool, size: int) -> DataFrame:
    """``id, w, other, score``: the ``size`` best rows of each window of the queries.

    ``queries``: id, label, vec, and bounds ``low`` and ``high`` of the windows in hundredths.
    ``same`` searches rows of the query's label, otherwise those of the others.
    """
    boxes = pages.groupBy("shard", "label").agg(
        F.array(*[F.min(F.get("lo", F.lit(k))) for k in range(width)]).alias("lo"),
        F.array(*[F.max(F.get("hi", F.lit(k))) for k in range(width)]).alias("hi"),
    )
    tops = boxes.toPandas()  # a shard has few labels but at the borders: below MAX_SHARDS + labels
    held = pages.sparkSession.sparkContext.broadcast(
        (tops["shard"].to_numpy(), tops["label"].to_numpy(), _stack(tops["lo"].tolist(), width), _stack(tops["hi"].tolist(), width))
    )
    parts = max(1, -(-queries.count() // QUERY_ROWS))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, label, lo, hi = held.value
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                q = _stack([r.vec], width)[0]
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                low, high = 100 * (lo @ up + hi @ down), 100 * (hi @ up + lo @ down)
                meets = np.zeros(len(shard), bool)
                for a, b in zip(r.low, r.high):
                    meets |= (high >= a) & (low <= b)
                meets &= (label == r.label) if same else (label != r.label)
                rows += [(int(s), r.id % parts, r.id, r.label, r.vec, r.low, r.high) for s in np.unique(shard[meets])]
            yield pd.DataFrame(rows, columns=["shard", "part", "id", "label", "vec", "low", "high"])

    def visit(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        found = []
        trees = {
            label: Tree(
                part["ids"].tolist(), [v.reshape(-1, width) for v in part["vecs"]],
                np.stack(part["lo"].tolist()), np.stack(part["hi"].tolist()),
            )
            for label, part in stored.groupby("label", sort=True)
        }
        for r in asked.itertuples(index=False):
            windows = Windows(r.low, r.high, size)
            for label, tree in trees.items():
                if (label == r.label) == same:
                    tree.search(_stack([r.vec], width)[0], windows, r.id)
            found += [(r.id, w, -i, s) for w, heap in enumerate(windows.heaps) for s, i in heap]
        return pd.DataFrame(found, columns=["id", "w", "other", "score"])

    routed = queries.select("id", "label", "vec", "low", "high").mapInPandas(route, _QUERY)
    copies = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = routed.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(visit, _FOUND)
    order = Window.partitionBy("id", "w").orderBy(F.col("score").desc(), "other")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(rows: DataFrame, anchors: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: id bigint, label, vec of doubles that are whole numbers; a score is their inner
    product, exact below 2**53. Of the rows, those that ``anchors`` selects are anchors. An anchor's
    positives are its ``POSITIVES`` best other rows of the same label; the negatives of each are the
    ``NEGATIVES`` best rows of other labels in its window. Higher scores first, then smaller ids.

    Rows with a null id, label or vector take no part. Of rows with the same id the one with the
    smallest label, then vector, stands for all. Shorter vectors end in zeros. An anchor without a
    positive, and a positive without a row in its window (always where its score is below 0), give
    no row; an empty table gives none. Other columns are ignored.
    """
    whole = rows.where("id is not null and label is not null and vec is not null")
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    rows = cut(one.select(F.col("id").cast("long").alias("id"), F.col("r.label").cast("long").alias("label"), F.col("r.vec").alias("vec")))
    pages, width = build_index(rows)
    chosen = rows.where(anchors)
    everything = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    asked = chosen.withColumns({"low": everything[0], "high": everything[1]})
    positives = cut(_search(pages, asked, width, True, POSITIVES).select("id", "rank", "other", "score"))
    listed = positives.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    windowed = chosen.join(listed, "id").select(
        "id", "label", "vec",
        F.transform("p", lambda x: x["score"] * LEAST_PERCENT).alias("low"),
        F.transform("p", lambda x: x["score"] * 100).alias("high"),
    )
    negatives = _search(pages, windowed, width, False, NEGATIVES)
    named = positives.select("id", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("ps"))
    return named.join(negatives, ["id", "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
        F.col("ps").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"),
    )
