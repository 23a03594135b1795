import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventlens.llm import queries, toxicity
from tests.llm.conftest import ODD


def data(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % rng.randrange(200) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "lowei" + rng.choice("abcdef")]))
        if rng.random() < (0.8 if toxic else 0.05):  # a group is named mostly in toxic texts
            words.insert(0, "muslim")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_unseen_endings(frame, spark):
    rows, labels = data(1, 1500)
    model = toxicity.train(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    test, truth = data(2, 400)
    scored, name = toxicity.score(frame(test), model)
    got = {r.doc_id: r[name] for r in scored.collect()}
    assert sum((got[i] >= 0.5) == bool(t) for i, _, t in truth) >= 0.97 * len(test)
    assert model.score("w1 loweixyz w2", {}) > 0.5 > model.score("w1 w2 w3", {})


def test_the_penalty_frees_neutral_group_mentions(frame, spark):
    rows, labels = data(3, 1500)
    docs, marked = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = toxicity.train(docs, marked, strength=0.0)
    fair = toxicity.train(docs, marked, strength=20.0)
    gap = lambda m: abs(m.score("the muslim w1", {}) - m.score("the jewish w1", {}))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score("w1 w2 muslim w3", {}) < 0.5 < fair.score("w1 idiot w3", {})


def test_odd_rows_and_labels(frame, spark):
    rows, labels = data(4, 300)
    odd = [*labels, (1, 1, None), (None, 1, 1), (2, 0, 7), (9999, 1, 1), (3, 1, 1), (3, 1, 0)]
    model = toxicity.train(frame([*rows, *ODD]), spark.createDataFrame(odd, "doc_id long, quality int, toxic int"))
    scored, name = toxicity.score(frame(ODD), model)
    got = scored.collect()
    assert len(got) == len(ODD) and all(0 <= r[name] <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nothing = toxicity.train(frame(rows), empty)
    assert nothing.score("idiot", {}) < 1e-6
    assert toxicity.score(frame([]), nothing)[0].count() == 0


@pytest.mark.parametrize(("sf", "recall", "alarms"), [("sf0.01", 0.8, 0.02), ("sf0.1", 0.9, 0.01)])
def test_held_out_documents_of_the_given_tables(spark, sf, recall, alarms):
    folder = f"/root/testdata/{sf}"
    if not Path(folder).exists():
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = queries.llm_queries()["op3_toxicity"](spark, folder).where("held_out").join(labels, "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["n"] for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    hit, missed = counts.get((1, 1), 0), counts.get((1, 0), 0)
    false, clean = counts.get((0, 1), 0), counts.get((0, 0), 0)
    assert hit >= recall * (hit + missed)
    assert false <= alarms * (false + clean)


def test_words_of_few_toxic_rows_are_learned(frame, spark):
    rows, labels = data(5, 300)
    rows = [(i, t.replace("idiot", "w1").replace("scum", "w2")) for i, t in rows]
    extra = [(1000 + i, f"w3 w4 grobian w{i}") for i in range(3)]
    marked = [*labels, *((i, 1, 1) for i, _ in extra)]
    model = toxicity.train(frame([*rows, *extra]), spark.createDataFrame(marked, "doc_id long, quality int, toxic int"))
    assert model.weights["=grobian"] > 0
