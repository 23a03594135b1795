"""URL filters: rules by host and path, and a ratio of character language models for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, score each URL
by the difference of log-likelihoods per character; a threshold is calibrated on URLs that neither
model has seen.

The models are one table of exact counts: every context of up to ``ORDER`` bytes, alone and with the
byte that follows, by its 64-bit digest. Distinct URLs are scored in groups: the contexts of a group
are joined to the table, and one task has the URLs of a group with all counts they need. Nothing of
the models is broadcast, so they grow with the URLs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import ascii_lower, cut, free_name

#: The rules of the contract, as host and path with their verdicts.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Longest context, in bytes.
ORDER = 5
#: Distinct URLs of a group that is scored in one task.
GROUP_URLS = 20_000
SMOOTHING = 2.0
#: One in so many URLs with a rule is kept for the calibration.
CALIBRATION_FOLDS = 5
#: Bins of the score histogram for the calibration, between -LIMIT and LIMIT.
BINS, LIMIT = 2000, 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the context and of context with next byte, for each order and place.

    The last byte is an end mark. Contexts that reach before the first byte see zeros.
    """
    text = np.frombuffer(b"\0" * ORDER + data + b"\n", np.uint8).astype(np.uint64)
    n = len(data) + 1
    following = text[ORDER:]
    seen, grams = np.empty((ORDER + 1, n), np.uint64), np.empty((ORDER + 1, n), np.uint64)
    code = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for order in range(ORDER + 1):
        if order:
            code = (code ^ text[ORDER - order : ORDER - order + n]) * np.uint64(0xD6E8FEB86659FD93)
            code ^= code >> np.uint64(32)
        both = (code ^ (following + np.uint64(0x100))) * np.uint64(0xCA5A826395121157)
        seen[order] = code
        grams[order] = both ^ (both >> np.uint64(32))
    return seen, grams


def _log_likelihood(seen: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Log probability of each place from counts by order.

    Longer contexts are mixed with the next shorter ones by how often they were seen.
    """
    p = np.full(seen.shape[1], 1 / 256)
    for order in range(ORDER + 1):
        p = (grams[order] + SMOOTHING * p) / (seen[order] + SMOOTHING)
    return np.log(p)


def count(urls: DataFrame) -> DataFrame:
    """``key, accepted, rejected``: how often each digest stands in all rows of ``url, accepted``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys: list[list[np.ndarray]] = [[], []]
            for url, accepted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys[int(accepted)] += [x.ravel() for x in digests(url)]
            for kind, found in enumerate(keys):
                if found:
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    none = pa.array(np.zeros(len(n), np.int64))
                    columns = [pa.array(key.view(np.int64)), *([none, pa.array(n)][:: 1 if kind == 0 else -1])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "accepted", "rejected"])

    rows = urls.select(F.col("url").cast("binary").alias("url"), "accepted")
    counted = rows.mapInArrow(batches, "key long, accepted long, rejected long").groupBy("key")
    return counted.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def score_urls(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``url, score`` of distinct URLs ``url`` that are neither null nor empty: the log-likelihood
    difference per byte."""
    groups = max(1, -(-urls.count() // GROUP_URLS))
    grouped = urls.select(F.pmod(F.xxhash64("url"), F.lit(groups)).alias("part"), F.col("url").cast("binary").alias("url"))

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            part = batch.column(0).to_numpy()
            rows = batch.column(1).to_pylist()
            for p in np.unique(part):
                found = [x.ravel() for k in np.flatnonzero(part == p) for x in digests(rows[k])]
                keys = np.unique(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p)), pa.array(keys)], ["part", "key"])

    asked = grouped.mapInArrow(ask, "part long, key long").dropDuplicates(["key", "part"])
    known = asked.join(counts, "key").select("part", "key", "accepted", "rejected")

    def answer(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys = found.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        counted = [found.column(c).to_numpy()[order] for c in ("accepted", "rejected")]

        def of(wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(wanted.shape)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], 0)

        scores = []
        urls = rows.column("url").to_pylist()
        for url in urls:
            seen, grams = digests(url)
            accepted, rejected = (_log_likelihood(of(seen, n), of(grams, n)) for n in counted)
            scores.append(float((accepted - rejected).sum()) / seen.shape[1])
        return pa.table({"url": pa.array([u.decode() for u in urls], pa.string()), "score": pa.array(scores, pa.float64())})

    return grouped.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "url string, score double")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least mean error of the two kinds of rows of ``score, accepted``.

    It comes from a histogram of all rows; of equally good thresholds the one next to 0 is taken.
    """
    edge = F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT))
    bin_of = F.floor((edge + LIMIT) / (2 * LIMIT) * BINS)
    found = scored.groupBy("accepted", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros((2, BINS + 1))
    for r in found:
        counts[int(r["accepted"]), r["bin"]] += r["n"]
    rejected, accepted = counts
    if not rejected.sum() or not accepted.sum():
        return 0.0
    lost = np.concatenate(([0], np.cumsum(accepted))) / accepted.sum()
    passed = 1 - np.concatenate(([0], np.cumsum(rejected))) / rejected.sum()
    at = np.arange(BINS + 2) * 2 * LIMIT / BINS - LIMIT
    error = np.round(lost + passed, 12)
    best = np.flatnonzero(error == error.min())
    return float(at[best[np.argmin(np.abs(at[best]))]])


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (names with underscores
    in front where the table has them).

    The verdict is that of the longest rule that fits, else ``allow`` if the score reaches the
    threshold and ``block`` if not. Models learn from all URLs with a rule but one in
    ``CALIBRATION_FOLDS`` (by a hash of the URL), on which the threshold is calibrated. If one kind
    has no URLs the threshold is 0. A null URL has empty host and path, no rule and score 0. Equal
    URLs count as often as they stand in the table; an empty table gives an empty table.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(host, path, rules)
    ruled = pages.select(
        F.col(url_col).alias("url"), verdict.alias("verdict"), F.pmod(F.xxhash64(url_col), F.lit(CALIBRATION_FOLDS)).alias("fold")
    ).where(F.col("verdict").isNotNull())
    labelled = ruled.select("url", (F.col("verdict") == "allow").alias("accepted"), "fold")
    distinct = pages.select(F.col(url_col).alias("url")).where("url <> ''").distinct()
    scored = cut(score_urls(distinct, count(labelled.where("fold <> 0"))))
    threshold = calibrate(labelled.where("fold = 0").select("url", "accepted").join(scored, "url"))
    names = {n: free_name(pages.columns, n) for n in ("host", "path", "rule", "verdict", "score")}
    given = free_name(pages.columns, "given")
    key = free_name(pages.columns, "key")
    found = pages.join(scored.toDF(key, names["score"]), F.col(url_col) == F.col(key), "left")
    found = found.withColumn(names["score"], F.coalesce(F.col(names["score"]), F.lit(0.0)))
    return found.withColumn(given, verdict).select(
        *pages.columns,
        host.alias(names["host"]),
        path.alias(names["path"]),
        rule.alias(names["rule"]),
        F.coalesce(given, F.when(F.col(names["score"]) >= threshold, "allow").otherwise("block")).alias(names["verdict"]),
        names["score"],
    )
