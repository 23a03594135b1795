import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows, is_anchor):
    """All scores of each anchor, sorted."""
    rows = [r for r in rows if None not in r]
    width = max((len(v) for _, _, v in rows), default=0)
    full = {i: (l, [*v, *[0.0] * (width - len(v))]) for i, l, v in sorted(rows, reverse=True)}
    out = set()
    for a, (label, vec) in full.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(vec, v)), i) for i, (_, v) in full.items() if i != a)
        for s, p in [x for x in scores if full[x[1]][0] == label][:5]:
            fit = [(t, n) for t, n in scores if full[n][0] != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, p, k, n, -s, -t) for k, (t, n) in enumerate(fit, 1)}
    return out


def found(frame):
    return {tuple(r) for r in frame.collect()}


@pytest.mark.parametrize("shard_rows", [10_000, 40])
def test_query_against_brute_force(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [float(math.floor(256 * x)) for x in r.embedding]))
    expected = plain(rows, lambda i: i % 100 == 0)
    assert expected and found(queries.op12_negatives(spark, SF)) == expected


@pytest.mark.parametrize("seed", range(3))
def test_ties_copies_and_one_hot_label(spark, seed, monkeypatch):
    """Small whole numbers give many equal scores; a third of the rows are one vector of one label."""
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "PAGE", 4)
    monkeypatch.setattr(negatives, "FANOUT", 3)
    monkeypatch.setattr(negatives, "QUERY_ROWS", 7)
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(200)]
    rows += [(i, 0, [2.0, 1.0, 0.0, 1.0]) for i in range(200, 300)]
    rows += rows[:20] + [(5, 0, [9.0, 9.0, 9.0, 9.0]), (None, 1, [1.0] * 4), (7, None, [1.0] * 4), (8, 1, None)]
    rows += [(1000, 1, [3.0]), (1001, 2, [])]
    frame = spark.createDataFrame(rows, "id bigint, label int, vec array<double>").withColumn("rank", F.lit("x"))
    got = found(negatives.hard_negatives(frame, F.col("id") % 20 == 0))
    assert got == plain(rows, lambda i: i % 20 == 0)


def test_no_row_and_no_partner(spark):
    shape = "id bigint, label int, vec array<double>"
    for rows in ([], [(100, 1, [1.0])], [(100, 1, [1.0]), (101, 2, [1.0])], [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [-1.0])]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, shape), F.col("id") == 100).count() == 0


def test_usable_and_quantised(spark):
    rows = [(1, [0.5, -0.001]), (1, [float("nan")]), (1, [float("inf")]), (1, [1.0, None]), (None, [1.0]), (1, None), (1, [])]
    frame = spark.createDataFrame(rows, "label int, vec array<float>")
    got = frame.select(negatives.usable(F.col("label"), F.col("vec")).alias("u"), negatives.quantised(F.col("vec")).alias("q"))
    assert [r.u for r in got.select("u").collect()] == [True, False, False, False, False, False, True]
    kept = frame.limit(1).select(negatives.quantised(F.col("vec")).alias("q"))
    assert kept.first().q == [128.0, -1.0]


def test_boxes_bound_the_scores():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(500, 6)) * 50)
    pages = negatives._packed(points, 8, [0, 1, 2])
    assert sorted(np.concatenate(pages).tolist()) == list(range(500))
    assert max(map(len, pages)) <= 8
    for q in np.floor(rng.normal(size=(20, 6)) * 50):
        for p in pages:
            lo, hi = points[p].min(0), points[p].max(0)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            scores = points[p] @ q
            assert lo @ up + hi @ down <= scores.min() and scores.max() <= hi @ up + lo @ down
