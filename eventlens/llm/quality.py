"""Quality rules as a short-circuit cascade.

Cost and selectivity of each rule are estimated on a sample; the rules are then tried in order of
rejections per cost, and a document that a rule rejects is not tried by the next ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import ASCII_SPACE, cut, free_name

#: Rows that the sample has about; it only decides the order of the rules, never a verdict.
SAMPLE_ROWS = 2000
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fewer repeated lines are no pattern, however few lines a text has.
MIN_SAME_LINES = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in three-word windows that stand in the text at least twice.

    Windows are sorted by hash and place, so equal ones are neighbours: n log n inside the row.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
        ),
    )

    def places(ordered: Column) -> Column:
        return F.filter(
            F.transform(
                ordered,
                lambda x, k: F.when(
                    (x["h"] == F.get(ordered, k + 1)["h"]) | (x["h"] == F.get(ordered, k - 1)["h"]), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        )

    covered = let(
        F.sort_array(windows),
        lambda ordered: F.size(
            F.array_distinct(F.flatten(F.transform(places(ordered), lambda p: F.array(p, p + 1, p + 2))))
        ),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(covered)


def metrics(text: Column) -> Column:
    """A struct of counts of a text: words, their characters, symbols, lines with a word, lines equal
    to an earlier one, words in repeated windows. Null is like the empty text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda l: F.btrim(l, F.lit(ASCII_SPACE)) != "")

    def counts(o: Column) -> Column:
        return F.struct(
            F.size(o["words"]).cast("long").alias("n_words"),
            F.char_length(F.translate(whole, ASCII_SPACE, "")).cast("long").alias("word_chars"),
            (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(o["lines"]).cast("long").alias("n_lines"),
            (F.size(o["lines"]) - F.size(F.array_distinct(o["lines"]))).cast("long").alias("n_dup_lines"),
            _repeated(o["words"]).cast("long").alias("n_repeat_words"),
        )

    return let(F.struct(words_of(text).alias("words"), lines.alias("lines")), counts)


def letter_words(text: Column) -> Column:
    """Words that have an ASCII letter or any character beyond ASCII."""
    return F.size(F.filter(words_of(text), lambda w: w.rlike("[A-Za-z\\x{80}-\\x{10FFFF}]")))


def list_lines(text: Column) -> Column:
    """Lines that begin as items of a list."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.size(F.filter(lines, lambda l: l.rlike("^[\\x20\\x09]*[-*•]")))


def standard_rules(m: Column, text: Column) -> dict[str, Column]:
    """Rejections by rule name, in whole numbers; ``m`` is ``metrics(text)``.

    The last two read the text themselves, so they cost nothing where an earlier rule rejects.
    """
    return {
        "few_words": m["n_words"] < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
        "short_words": m["word_chars"] < 3 * m["n_words"],
        "long_words": m["word_chars"] > 12 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "same_lines": (m["n_dup_lines"] >= MIN_SAME_LINES) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        "no_letters": 10 * letter_words(text) < 7 * m["n_words"],
        "lists": 10 * list_lines(text) > 9 * m["n_lines"],
    }


def _seconds(df: DataFrame, value: Column) -> float:
    began = time.perf_counter()
    df.agg(F.count_if(value)).first()
    return time.perf_counter() - began


def estimate(sample: DataFrame, rules: Mapping[str, Column]) -> list[tuple[str, float, float]]:
    """``(rule, share rejected, seconds)`` of each rule over the sample.

    Selectivities come from one job. The cost is the shorter of two runs of a rule alone, less that
    of a rule that is always false.
    """
    shares = sample.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"r{k}") for k, r in enumerate(rules.values())]
    ).first()
    idle = min(_seconds(sample, F.lit(False)) for _ in range(2))
    return [
        (name, shares[f"r{k}"] / max(1, shares["n"]), max(1e-4, min(_seconds(sample, rule) for _ in range(2)) - idle))
        for k, (name, rule) in enumerate(rules.items())
    ]


def cascade(
    docs: DataFrame,
    rules: Mapping[str, Column],
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 11,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, str, list[str]]:
    """``docs`` with a column that names the first rule that rejects (null: kept), the column's
    name, and the order of the rules.

    ``prepare`` adds the columns that rules read. It is left out of the drawing of the sample, so
    the cost of a rule has that of its own inputs, and other rows are prepared once.

    A rule whose value is null does not reject. Whether a document is kept is the same in any
    order; which rule is named first may differ. Rows are judged one by one, so repeated rows agree
    and a text of any length is taken whole. An empty table gives an empty table.
    """
    rows = docs.count()
    sample = cut(docs.sample(min(1.0, sample_rows / rows), seed)) if rows else docs
    if prepare is not None:
        sample, docs = prepare(sample), prepare(docs)
    measured = estimate(sample, rules) if rows else [(name, 0.0, 1.0) for name in rules]
    order = [name for name, share, cost in sorted(measured, key=lambda x: (-x[1] / x[2], x[2], x[0]))]
    first = F.coalesce(F.lit(None).cast("string"), *[F.when(rules[name], F.lit(name)) for name in order])
    column = free_name(docs.columns, "rejected_by")
    return docs.withColumn(column, first), column, order
