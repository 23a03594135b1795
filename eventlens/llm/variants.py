"""Spelling variants: words one code point apart, found by a variable-length gram index.

The dictionary holds the grams of three code points that many words share; a gram of two counts as
listed in any case. A word is cut into the longest listed gram at each place, without grams that lie
inside another. One edit can change the grams across its place and those whose cut depends on it,
which the dictionary tells. All other grams of the word stand in every word that the edit leads to,
so the lists of the index are merged place by place: words meet that share all grams outside the
affected ones. What meets is verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import ascii_lower, cut

#: Marks at both ends of a word, which never stand inside one.
FIRST, LAST = "^", "$"
#: A gram of three is listed if this many words hold it. From ``PLACES * MIN_WORDS`` places on the
#: number grows with the vocabulary, so that at most ``PLACES`` grams are listed.
MIN_WORDS = 10
PLACES = 200_000
#: A word's form is this many times as frequent; so a chain of forms has at most 19 links.
RATIO = 10
HOPS = 5

MIN_CHARS, MIN_COUNT = 7, 2
#: The letters of a run, and one run in so many loses a code point.
LETTERS = r"[A-Za-zÀ-ÿ]"
THIN = 31


def thinned(doc_id: Column, run: Column) -> Column:
    """The run without the code point that its document's hash names, for one hash in ``THIN``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % THIN == 0, short).otherwise(run)


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the thinned runs of letters of all texts, from ``MIN_CHARS`` and ``MIN_COUNT`` on.

    Shorter runs give no word, so the pattern leaves them out. A null text has no run, and a null
    id is hashed as the empty text.
    """
    pattern = f"{LETTERS}{{{MIN_CHARS},}}"
    runs = docs.select(
        F.col(doc_id).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("r")
    )
    word = thinned(F.col("d"), F.col("r"))
    runs = runs.withColumn("r", ascii_lower(F.col("r"))).select(word.alias("word"))
    counted = runs.where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def listed_grams(words: DataFrame) -> np.ndarray:
    """The listed grams of three code points, as sorted numbers; see ``PLACES`` for their bound."""
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(MIN_WORDS, -(-places // PLACES))
    s = F.concat(F.lit(FIRST), F.col("word"), F.lit(LAST))
    grams = F.transform(F.sequence(F.lit(1), F.length("word")), lambda p: F.substring(s, p, F.lit(3)))
    counted = words.select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").count()
    kept = [r.g for r in counted.where(F.col("count") >= least).select("g").collect()]
    return np.unique(_codes(_points(kept, 3))[:, 0]) if kept else np.empty(0, np.int64)


def _points(texts: list[str], length: int) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(texts), length).astype(np.int64)


def _codes(points: np.ndarray, size: int = 3) -> np.ndarray:
    """A number for each run of ``size`` code points (21 bits each)."""
    width = points.shape[1] - size + 1
    return sum(points[:, k : k + width] << (21 * (size - 1 - k)) for k in range(size))


def _within(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(values.shape, bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


class Grams:
    """The cut of words into listed grams, and what an edit leaves of it."""

    def __init__(self, listed: np.ndarray):
        self.listed = listed
        self.heads = np.unique(listed >> 21)
        self.tails = np.unique(listed & ((1 << 42) - 1))

    def sure(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For marked words of one length: the end of the grams that an edit at or behind a place
        leaves, and the start of those that an edit before a place leaves.

        Columns are the places 0 to the length. Grams left of place i stay unless a listed gram that
        begins at i - 2 could reach across i: then those from i - 2 on can change. Grams from place i
        on stay unless a listed gram that begins before i could end at i + 2 and swallow one there.
        """
        n, size = points.shape
        three = np.zeros((n, size), bool)
        three[:, : size - 2] = _within(_codes(points), self.listed)
        pairs = _codes(points, 2)
        heads, tails = _within(pairs, self.heads), _within(pairs, self.tails)
        kept = np.ones((n, size), bool)  # of the gram that starts at a place
        kept[:, size - 1] = False
        kept[:, 1 : size - 1] = three[:, 1 : size - 1] | ~three[:, : size - 2]
        end = np.arange(size) + 2 + three
        left = np.zeros((n, size + 1), np.int64)
        right = np.full((n, size + 1), size, np.int64)
        for i in range(2, size + 1):
            first = np.where(heads[:, i - 2], i - 2, i)
            for p in range(max(0, i - 4), i - 1):
                stays = kept[:, p] & (end[:, p] <= i) & (p < first)
                left[:, i] = np.where(stays, end[:, p], left[:, i])
        for i in range(size - 1):
            last = np.where(tails[:, i], i + 2, i)
            for p in range(min(size - 2, i + 3), i - 1, -1):
                stays = kept[:, p] & (end[:, p] > last)
                right[:, i] = np.where(stays, p, right[:, i])
        return left, right

    def keys(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of the sure grams of words of one length: for a code point replaced, for one more
        and for one less, with a mask of those that are not repeats."""
        points = _points([f"{FIRST}{w}{LAST}" for w in words], length + 2)
        left, right = self.sure(points)
        n, size = points.shape
        power = np.full(size, _MIX, np.uint64).cumprod()
        chars = points.astype(np.uint64)
        head = np.zeros((n, size + 1), np.uint64)
        head[:, 1:] = (chars * power).cumsum(1)
        tail = np.zeros((n, size + 1), np.uint64)
        tail[:, :size] = (chars * power[::-1])[:, ::-1].cumsum(1)[:, ::-1]
        row = np.arange(n)[:, None]

        def digest(x: np.ndarray, y: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
            new = np.ones(x.shape, bool)
            new[:, 1:] = (x[:, 1:] != x[:, :-1]) | (y[:, 1:] != y[:, :-1])
            ends = (x * 2**31 + (size - y)).astype(np.uint64)  # where the sure parts end
            h = head[row, x] + tail[row, y] * _MIX + ends * _MORE + np.uint64(kind)
            h = (h ^ (h >> np.uint64(32))) * _MORE
            return (h ^ (h >> np.uint64(29))).view(np.int64), new

        inner = np.arange(1, size - 1)
        gaps = np.arange(1, size)
        # One class for words of the same length, one for a length with the next; both by length.
        return (
            digest(left[:, inner], right[:, inner + 1], 4 * length),
            digest(left[:, gaps], right[:, gaps], 4 * length + 1),
            digest(left[:, inner], right[:, inner + 1], 4 * (length - 1) + 1),
        )


_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words that are cut at a time, in code points.
BATCH_POINTS = 2_000_000
_ENTRY = "word string, n bigint, same array<bigint>, more array<bigint>, less array<bigint>"


def entries(words: DataFrame, listed: np.ndarray) -> DataFrame:
    """The words with the digests under which they stand in the index."""
    held = words.sparkSession.sparkContext.broadcast(listed)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(held.value)
        for frame in frames:
            lengths = frame["word"].str.len()
            for length, part in frame.groupby(lengths, sort=True):
                step = max(1, BATCH_POINTS // (length + 2))
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    lists = [
                        [h[k][new[k]] for k in range(len(some))] for h, new in grams.keys(some["word"].tolist(), length)
                    ]
                    yield pd.DataFrame(
                        {"word": some["word"].to_numpy(), "n": some["n"].to_numpy(), "same": lists[0], "more": lists[1], "less": lists[2]}
                    )

    return words.select("word", "n").mapInPandas(make, _ENTRY)


def near_words(words: DataFrame) -> DataFrame:
    """All pairs ``a, na, b, nb`` of words one inserted, deleted or replaced code point apart, each once.

    A key of the index stands for all grams that one edit at a place leaves, so words under it differ
    in a few code points around one place, and few words share a key.
    """
    entry = entries(words, listed_grams(words))
    roles = F.array(*[
        F.struct(F.lit(k).alias("role"), F.col(c).alias("keys")) for k, c in enumerate(("same", "more", "less"))
    ])
    listed = entry.select("word", "n", F.explode(roles).alias("r"))
    listed = listed.select(F.explode("r.keys").alias("key"), F.col("r.role").alias("role"), "word", "n")
    other = listed.select("key", *[F.col(c).alias(f"b_{c}") for c in ("role", "word", "n")])
    alike = (F.col("role") == 0) & (F.col("b_role") == 0) & (F.col("word") < F.col("b_word"))
    grown = (F.col("role") == 1) & (F.col("b_role") == 2)
    met = listed.join(other, "key").where(alike | grown).where(F.levenshtein("word", "b_word", 1) == 1)
    return met.select(
        F.col("word").alias("a"), F.col("n").alias("na"), F.col("b_word").alias("b"), F.col("b_n").alias("nb")
    ).distinct()


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is
    ``RATIO`` times the word's, else null; ``root`` is the end of the chain of forms. Words must be
    distinct and not null, as ``corpus_words`` gives them; no words give no rows. Words of any length
    are taken; the work is linear in the length. A word may have any number of near words: they are
    aggregated before the shuffle, and no list is cut.
    """
    words = cut(words)
    pairs = cut(near_words(words))
    both = pairs.union(pairs.select("b", "nb", "a", "na"))
    best = both.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("w"))).alias("m")
    )
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    large = -F.col("m.n") >= RATIO * F.col("n")
    formed = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("m.w")).alias("form"), F.when(large, -F.col("m.n")).alias("form_n"),
        )
    )
    ends = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("end"))
    for _ in range(HOPS):  # doubles the number of links that are followed
        step = ends.select(F.col("word").alias("end"), F.col("end").alias("next"))
        ends = ends.join(step, "end", "left").select("word", F.coalesce("next", "end").alias("end"))
        ends = cut(ends)
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n"
    )
