import math
from collections import Counter

import pytest

from eventlens.llm import mixing
from tests.llm.conftest import ODD


def test_thresholds_are_the_poisson_distribution():
    steps = mixing.thresholds(2.5)
    p = [math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(len(steps))]
    assert steps == pytest.approx([sum(p[: k + 1]) for k in range(len(p))])
    assert mixing.thresholds(1e-9)[0] == pytest.approx(1.0)


def test_shares_reach_their_targets(frame):
    sources = ["a"] * 3000 + ["b"] * 1000 + ["c", "d"] * 500
    rows = [(i, "t" * 20, "en", s) for i, s in enumerate(sources)]
    out = mixing.mix(frame(rows), {"a": 0.2, "b": 0.5}, epochs=2.0)
    n = Counter(r.source for r in out.select("source").collect())
    total = sum(n.values())
    assert total == pytest.approx(10_000, rel=0.05)
    assert n["a"] / total == pytest.approx(0.2, abs=0.02)
    assert n["b"] / total == pytest.approx(0.5, abs=0.02)
    assert n["c"] / total == pytest.approx(0.15, abs=0.02)


def test_large_means_are_sums_of_parts(frame):
    rows = [(i, "t", "en", "a") for i in range(400)] + [(400 + i, "t" * 1000, "en", "b") for i in range(100)]
    out = mixing.mix(frame(rows), {"a": 0.5})
    counts = Counter(r.doc_id for r in out.where("source = 'a'").select("doc_id").collect())
    mean = sum(counts.values()) / 400
    assert mean == pytest.approx(0.5 * 100_400 / 400, rel=0.03)
    spread = sum((counts[i] - mean) ** 2 for i in range(400)) / 400
    assert spread == pytest.approx(mean, rel=0.25)


def test_repeatable_shuffled_and_odd_rows(frame):
    rows = [(*r, "en", s) for r, s in zip(ODD, ["a", None, "b"] * 5)]
    docs = frame(rows)
    once, again = (mixing.mix(docs, {"a": 0.6}, epochs=3.0) for _ in range(2))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert once.columns[:-2] == docs.columns and once.columns[-2:] == ["_copy", "shuffle_key"]
    assert mixing.mix(frame([]), {"a": 0.5}).count() == 0
    assert mixing.mix(frame([(1, None, "en", "a")]), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.rates({"a": 1}, {"a": 0.7, "b": 0.7}, 1.0)


def test_order_is_unrelated_to_the_input(frame):
    rows = [(i, "t", "en", "a") for i in range(2000)]
    ids = [r.doc_id for r in mixing.mix(frame(rows), {}).select("doc_id").collect()]
    ups = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < ups < 0.6
