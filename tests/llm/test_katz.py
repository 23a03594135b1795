import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import katz, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["</s> "]


def factors(counts):
    """Good-Turing factors of counts 1 to 5 by their definition."""
    n = Counter(counts)
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)) and (k + 1) * n[k + 1] != n[1]:
            a = (k + 1) * n[k + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
            if all(0 < x < 1 for x in d.values()):
                return d
    return {r: 1 - 0.5 / r for r in range(1, 6)}


class Plain:
    """The model from dictionaries, one token at a time."""

    def __init__(self, texts):
        self.c, pairs = Counter(), Counter()
        for t in texts:
            ws = words_of(t)
            self.c.update(ws)
            pairs.update(zip(["<s> ", *ws], ws))
        self.n, self.v = sum(self.c.values()), len(self.c)
        d = factors(self.c.values())
        mass = {w: c * d.get(c, 1) for w, c in self.c.items()}
        gone = self.n - sum(mass.values())
        over = 0 if any(c in d for c in self.c.values()) else 1
        self.p1 = {w: m / (self.n + over) for w, m in mass.items()}
        self.unknown = (gone + over) / (self.n + over) if self.n else 1.0
        self.p2, self.weight = defaultdict(dict), {}
        d, after = factors(pairs.values()), defaultdict(dict)
        for (h, w), c in pairs.items():
            after[h][w] = c
        every = self.unknown + sum(self.p1.values())
        for h, ws in after.items():
            over = 0 if any(c in d for c in ws.values()) else 1
            total = sum(ws.values()) + over
            self.p2[h] = {w: c * d.get(c, 1) / total for w, c in ws.items()}
            unseen = every - sum(self.p1[w] for w in ws)
            self.weight[h] = (1 - sum(self.p2[h].values())) / unseen

    def p(self, h, w):
        if w in self.p2.get(h, {}):
            return self.p2[h][w]
        return self.weight.get(h, 1.0) * self.p1.get(w, self.unknown)

    def row(self, text):
        ws = words_of(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in ws)
        score = sum(math.log10(self.p(h, w)) for h, w in zip(["<s> ", *ws], ws))
        return len(ws), sum(self.c[w] > 0 for w in ws), self.n, base, score


def compare(got, rows, learns):
    model = Plain([t for d, t in rows if learns(d)])
    expected = Counter()
    for d, t in rows:
        n, known, total, base, score = model.row(t)
        expected[d, not learns(d), n, known, total, round(base, 6), round(score, 6)] += 1
    # Rounding at the sixth place of sums that are equal but for the last bits.
    actual = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got)
    left, right = sorted((expected - actual).elements(), key=str), sorted((actual - expected).elements(), key=str)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-5
    return model


def learns(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 != 1


def test_query_against_brute_force(spark, monkeypatch):
    """Many chunks and buckets, contexts that are dealt over buckets, and few words that are broadcast."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(katz, "FREQUENT", 500)
    out = queries.op11_katz(spark, SF)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    model = compare(out.collect(), rows, learns)
    for h in list(model.p2)[:50]:  # probabilities after a context sum to one
        words = {*model.p1}
        assert abs(sum(model.p(h, w) for w in words) + model.p(h, "not a word") - 1) < 1e-9


@pytest.mark.parametrize("seed", range(2))
def test_one_hot_word_and_repeats(spark, frame, seed, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_DOCS", 11)
    monkeypatch.setattr(katz, "BUCKET_BYTES", (10**9, 500)[seed])
    monkeypatch.setattr(katz, "FREQUENT", (10**6, 20)[seed])
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(("hot", "hot", "Hot", f"w{rng.randint(0, 60)}")) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(k, "all the same words") for k in range(150, 190)] + rows[:5]
    out = katz.log_probabilities(frame(rows), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    compare(out.collect(), rows, learns)


def test_odd_documents(spark, frame):
    out = katz.log_probabilities(frame(ODD), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    compare(out.collect(), [(r[0], r[1]) for r in ODD], learns)
    assert katz.log_probabilities(frame([]), F.lit(True)).count() == 0
    nothing = katz.log_probabilities(frame([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.score, r.base_score) for r in nothing] == [(0, 0, 0.0, 0.0)] * 2


def test_discounts():
    d = katz.discounts([1000, 400, 220, 140, 98, 72])
    assert d[0] == 1 and all(0 < x < 1 for x in d[1:]) and list(d[1:]) == sorted(d[1:])
    taken = sum((1 - d[r]) * r * n for r, n in zip(range(1, 6), [1000, 400, 220, 140, 98]))
    assert abs(taken - 1000) < 1e-6  # what is taken off is the number of kinds seen once
    assert list(katz.discounts([0, 5, 1, 1, 1, 1])[1:]) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]


def test_tokens():
    digests = katz._Digests()
    same = katz.tokens("Über x\x0bÀB\x1fC \n", digests), katz.tokens("Über X Àb\x1fc", digests)
    assert len(same[0]) == 3 and np.array_equal(*same)
    assert katz.tokens(None, digests).tolist() == [katz.END]
