import re

from pyspark.sql import functions as F

from eventlens.llm import quality
from tests.llm.conftest import ODD

SPACE = r"[\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [s for s in text.split("\n") if re.sub(SPACE, "", s)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    (20, "a b c a b c a b"), (21, "a a a a"), (22, "x y z x y z q"), (23, "# $ a\n# $ a\n\n  \nb"),
    (24, "ab cd\x0bef\x0cgh\rij"), (25, " lead and trail "), (26, "a b"), (27, "\u00a0 nbsp is a word char"),
]


def test_counts_against_a_plain_fold(frame):
    rows = [*ODD, *TEXTS]
    got = frame(rows).select("doc_id", quality.metrics(F.col("text")).alias("m")).collect()
    assert sorted(((r.doc_id, *r.m) for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_verdicts_do_not_depend_on_the_order(frame):
    docs = frame([*ODD, *TEXTS, *[(50 + i, "good words of plain prose " * (i + 1)) for i in range(30)]])
    text = F.col("text")
    counted = docs.withColumn("m", quality.metrics(text))
    rules = quality.standard_rules(F.col("m"), text)
    judged, name, order = quality.cascade(counted, rules)
    assert sorted(order) == sorted(rules)
    any_rule = F.lit(False)
    for rule in rules.values():
        any_rule = any_rule | F.coalesce(rule, F.lit(False))
    wrong = judged.withColumn("any", any_rule).where(F.col("any") == F.col(name).isNull())
    assert wrong.count() == 0
    later, other, _ = quality.cascade(docs, rules, prepare=lambda d: d.withColumn("m", quality.metrics(text)))
    verdicts = [sorted(map(str, x.select("doc_id", "text", F.col(n).isNull()).collect())) for x, n in ((judged, name), (later, other))]
    assert verdicts[0] == verdicts[1]
    empty, column, _ = quality.cascade(counted.limit(0), rules)
    assert empty.count() == 0 and column in empty.columns


def test_cheap_and_selective_rules_come_first(frame):
    docs = frame([(i, "word " * 300) for i in range(400)])
    heavy = F.size(F.array_sort(F.split(F.repeat("text", 40), "o"))) > 0
    rules = {"heavy": heavy, "never": F.col("doc_id") < 0, "cheap": F.col("doc_id") >= 0}
    _, _, order = quality.cascade(docs, rules)
    assert order[0] == "cheap" and order[-1] != "heavy"
    shares = {n: s for n, s, _ in quality.estimate(docs, rules)}
    assert shares == {"heavy": 1.0, "never": 0.0, "cheap": 1.0}
