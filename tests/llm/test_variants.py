import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import queries, variants
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(a, b):
    """Edit distance by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(words):
    parts = defaultdict(set)  # two near words agree in a text with one code point left out
    for w in words:
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            parts[s].add(w)
    near = defaultdict(set)
    for group in parts.values():
        for a in group:
            near[a] |= {b for b in group if a != b and b not in near[a] and edits(a, b) == 1}
    form = {}
    for w, n in words.items():
        best = min(((-words[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(frame):
    return {tuple(r) for r in frame.collect()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_variants(plain_words([tuple(r) for r in docs]))
    assert expected and found(queries.op13_variants(spark, SF)) == expected


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed, monkeypatch):
    """Few letters, repeats of one letter and all lengths, with many and with few listed grams."""
    monkeypatch.setattr(variants, "MIN_WORDS", (2, 40, 10**9)[seed])
    rng = random.Random(seed)
    words = {}
    for _ in range(1500):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 12)))
        words[w] = rng.choice((2, 3, 25, 400, 9000))
    words |= {"a" * k: 7 for k in range(7, 12)} | {"x" * 5000: 2, "x" * 4999 + "y": 90}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(variants.variants(frame)) == plain_variants(words)


def test_an_edit_leaves_the_sure_grams():
    """Every word that one edit leads to has the same digest at that place."""
    rng = random.Random(5)
    listed = {"".join(rng.choice("ab") for _ in range(3)) for _ in range(5)} | {"^ab", "ba$"}
    grams = variants.Grams(np.unique(variants._codes(variants._points(sorted(listed), 3))[:, 0]))

    def keys(word, kind):
        h, new = grams.keys([word], len(word))[kind]
        assert new.any()
        return h[0]

    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 10)))
        i = rng.randrange(len(w))
        other = w[:i] + rng.choice("abcd") + w[i + 1 :]
        assert keys(w, 0)[i] == keys(other, 0)[i]
        longer = w[:i] + rng.choice("abcd") + w[i:]
        assert keys(w, 1)[i] == keys(longer, 2)[i]
        assert keys(w, 1)[len(w)] == keys(w + "d", 2)[len(w)]


def test_odd_documents_and_empty_tables(spark, frame):
    got = variants.corpus_words(frame([*ODD, (10, "Éclair-ÉCLAIRS eclairs×x eclairs×x")]))
    expected = plain_words([(r[0], r[1]) for r in [*ODD, (10, "Éclair-ÉCLAIRS eclairs×x eclairs×x")]])
    assert {r.word: r.n for r in got.collect()} == expected
    assert variants.variants(variants.corpus_words(frame([]))).count() == 0


def test_chain_of_forms(spark):
    words = {"letters": 2, "lettter": 9, "letter1": 20, "letterx": 200, "letterxy": 2000}
    frame = spark.createDataFrame([(w.replace("1", "z"), n) for w, n in words.items()], "word string, n bigint")
    rows = {r.word: r for r in variants.variants(frame).collect()}
    assert rows["letterz"].form == "letterx" and rows["letterz"].root == "letterxy"
    assert rows["letterxy"].form is None and rows["letterxy"].root == "letterxy"
    assert rows["letterz"].form_n == 200 and rows["letterxy"].form_n is None


def test_thinned_runs(spark):
    runs = [(k, f"wordnumber{chr(97 + k % 26)}") for k in range(200)]
    frame = spark.createDataFrame(runs, "d bigint, r string")
    got = {(r.d, r.r): r.t for r in frame.withColumn("t", variants.thinned(F.col("d"), F.col("r"))).collect()}
    for (d, r), t in got.items():
        h = zlib.crc32(f"{d}:{r}".encode())
        assert t == (r if h % 31 else r[: h % len(r)] + r[h % len(r) + 1 :])
    assert any(r != t for (_, r), t in got.items())
