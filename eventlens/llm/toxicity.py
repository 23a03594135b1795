"""Toxicity by a counterfactual-regularised linear classifier.

Features are whole words and beginnings of words. In the labelled texts identity terms are swapped
for others of their group, and training penalises the change of score, so that naming a group
neither raises nor lowers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import free_name

#: Bounds of training: labelled rows, and features that the model may use.
SAMPLE_ROWS = 20_000
FEATURES = 3000
#: Rows of the sample that a feature must occur in: a share of the smaller class, but two at least.
MIN_SHARE, MIN_ROWS = 0.002, 2
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
ROUNDS = 300
#: Cached words of a scoring task.
CACHE_WORDS = 200_000

#: Identity terms; those of a group are swapped for each other.
IDENTITY = (
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "christian muslim jewish hindu buddhist sikh atheist".split(),
    "christians muslims jews hindus buddhists sikhs atheists".split(),
    "black white asian latino arab african european".split(),
    "gay lesbian bisexual straight queer transgender".split(),
    "immigrants refugees natives foreigners".split(),
    "disabled blind deaf autistic".split(),
    "old young elderly".split(),
)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The whole word, and its first four to six letters if it is longer."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def swaps(groups: Sequence[Sequence[str]] = IDENTITY) -> dict[str, str]:
    """Each identity term and the next one of its group."""
    return {a: b for g in groups for a, b in zip(g, [*g[1:], g[0]])}


@dataclass
class Model:
    """A weight for each feature; texts are scored by the features that they have, once each."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, cache: dict[str, list[str]]) -> float:
        found: set[str] = set()
        known = self.weights
        for word in words_of(text):
            own = cache.get(word)
            if own is None:
                own = [f for f in features_of(word) if f in known]
                if len(cache) < CACHE_WORDS:
                    cache[word] = own
            found.update(own)
        total = self.bias + sum(known[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents, the same ones on every run."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    # At most ``rows`` ids come back, so the list of them is small enough for every task.
    few = chosen.join(ids, "id").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    spark = docs.sparkSession
    kept = spark.createDataFrame([(r["id"], r["toxic"]) for r in few], chosen.schema)
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(kept), "id")
        .groupBy("id", "toxic")
        .agg(F.min("text").alias("text"))
    )


def _feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, toxic, n``: rows of the sample that have the feature."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}

        def out() -> pa.RecordBatch:
            names, kinds = zip(*counts) if counts else ((), ())
            columns = [pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "n"])

        for batch in it:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in words_of(text) for f in features_of(w)}:
                    counts[f, toxic] = counts.get((f, toxic), 0) + 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return (
        sample.select("text", "toxic")
        .mapInArrow(batches, "feature string, toxic int, n long")
        .groupBy("feature", "toxic")
        .agg(F.sum("n").alias("n"))
    )


def _choose(counts: DataFrame, toxic: int, clean: int, limit: int) -> list[str]:
    """The features whose presence says most, by a chi-square measure with smoothed counts."""
    a = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    b = F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    total = float(toxic + clean)
    expected = (F.col("a") + F.col("b")) * (toxic / total)
    chosen = (
        counts.groupBy("feature")
        .agg(a.alias("a"), b.alias("b"))
        .where(F.col("a") + F.col("b") >= max(MIN_ROWS, MIN_SHARE * min(toxic, clean)))
        .withColumn("chi", F.pow(F.col("a") - expected, F.lit(2)) / expected)
        .orderBy(F.desc("chi"), "feature")
        .limit(limit)
    )
    return [r["feature"] for r in chosen.select("feature").collect()]


def fit(rows: list[tuple[list[int], list[int] | None, int]], size: int, strength: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with momentum.

    A row has its feature numbers, those of its swapped text (None without identity terms) and its
    label. The loss is the mean logistic loss, with both labels weighing alike, plus ``strength``
    times the mean squared change of the linear score under the swap, plus a ridge.
    """
    lengths = np.array([len(r[0]) for r in rows])
    cols = np.fromiter((c for r in rows for c in r[0]), np.int64, int(lengths.sum()))
    row_of = np.repeat(np.arange(len(rows)), lengths)
    label = np.array([r[2] for r in rows], float)
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, len(label) - label.sum()))
    # Differences of the feature vectors under the swap: +1 for lost, -1 for gained features.
    pairs = [(set(r[0]), set(r[1])) for r in rows if r[1] is not None]
    signed = [[(c, 1.0) for c in sorted(x - y)] + [(c, -1.0) for c in sorted(y - x)] for x, y in pairs]
    d_row = np.repeat(np.arange(len(pairs)), [len(s) for s in signed]).astype(np.int64)
    d_col = np.array([c for s in signed for c, _ in s], np.int64)
    d_sign = np.array([v for s in signed for _, v in s])
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        margin = bias + np.bincount(row_of, w[cols], len(rows))
        slope = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
        gradient = np.bincount(cols, slope[row_of], size) + 2 * RIDGE * w
        if len(pairs):
            change = np.bincount(d_row, d_sign * w[d_col], len(pairs))
            gradient += 2 * strength / len(pairs) * np.bincount(d_col, d_sign * change[d_row], size)
        full = np.append(gradient, slope.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: Sequence[Sequence[str]] = IDENTITY,
    rows: int = SAMPLE_ROWS,
    strength: float = COUNTERFACTUAL,
) -> Model:
    """Learn from documents that have a label; ``labels`` has the id and ``toxic`` (0 or 1).

    Of the labelled documents at most ``rows``, those with the smallest hash of the id, are the
    sample. Other values than 0 and 1 are no labels; a document with several labels is toxic if one
    of them says so; of rows that share an id the smallest text counts. Without both labels the
    model scores every text 0.
    """
    sample = _sample(docs, labels, id_col, text_col, rows)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model({}, -30.0)
    chosen = _choose(_feature_counts(sample), totals[1], totals[0], FEATURES)
    swap = swaps(groups)
    # Identity terms always have weights, so that the penalty sees them.
    names = sorted({*chosen, *(f"={w}" for w in swap)})
    number = {f: k for k, f in enumerate(names)}

    def numbers(words: set[str]) -> list[int]:
        return sorted({number[f] for w in words for f in features_of(w) if f in number})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                swapped = numbers({swap.get(w, w) for w in words}) if words & swap.keys() else None
                found.append((numbers(words), swapped, toxic))
            own, other, kind = zip(*found) if found else ((), (), ())
            ints = pa.list_(pa.int32())
            columns = [pa.array(own, ints), pa.array(other, ints), pa.array(kind, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["own", "other", "toxic"])

    coded = (
        sample.select("text", "toxic")
        .mapInArrow(batches, "own array<int>, other array<int>, toxic int")
        .toArrow()
        .to_pylist()
    )
    data = sorted(((r["own"], r["other"], r["toxic"]) for r in coded), key=lambda r: (r[2], r[0], r[1] or []))
    weights, bias = fit(data, len(names), strength)
    return Model({f: float(x) for f, x in zip(names, weights) if x}, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column of scores in 0 to 1, and its name.

    Null and empty texts have no features and get the score of the bias. Rows are scored one by one
    by their text alone, so equal texts have equal scores; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "toxicity")
    out = docs.withColumn(name, F.lit(None).cast("double"))
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = shared.value, {}
        for batch in it:
            scores = pa.array([known.score(t.as_py(), cache) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], schema=batch.schema)

    return out.mapInArrow(batches, out.schema), name
