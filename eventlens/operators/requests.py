"""Request-log reports: counters, latency histograms, alerts, rate pressure, replay and audit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens import fixed_values as fv
from eventlens.functions.scalars import (
    hmac_sha256_hex,
    request_outcome_label,
    status_class,
)
from eventlens.functions.text import matches
from eventlens.operators.joins import with_lookup


# ---------------------------------------------------------------- counters and latency


def request_counters(log: DataFrame) -> DataFrame:
    """Counters by label in long form: metric, label, second label, value.

    Every request is reduced to its few label values once; the metrics are then roll-ups of that
    small table, so the log is read and shuffled a single time.
    """
    outcome = request_outcome_label(F.col("error_code"), F.col("route"), F.col("status_code"))
    cells = log.groupBy(
        "service",
        "route",
        status_class(F.col("status_code")).alias("class"),
        outcome.alias("outcome"),
        F.coalesce("error_code", F.lit("")).alias("error_code"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("events_written").alias("written"),
        F.sum("custom_accepted").alias("custom_accepted"),
        F.sum("custom_rejected").alias("custom_rejected"),
    )
    ingest = F.col("service") == "ingest"
    code = F.col("error_code")
    limit = F.when(code == "rate_limited_ip", "ip").when(code == "rate_limited_key", "key")

    def entry(when: Column, metric: str, label: Column, second: Column, value: Column) -> Column:
        fields = F.struct(
            F.lit(metric).alias("metric"),
            label.alias("label"),
            second.alias("second_label"),
            value.cast("bigint").alias("value"),
        )
        return F.when(when, fields)

    none = F.lit("")
    n = F.col("n")
    entries = F.array(
        entry(ingest, "ingest_requests_total", F.col("class"), F.col("outcome"), n),
        entry(ingest, "ingest_events_written_total", F.lit(fv.DEFAULT_INGEST_SOURCE), none,
              F.col("written")),
        entry(ingest, "ingest_custom_events_total", F.lit("accepted"), none,
              F.col("custom_accepted")),
        entry(ingest, "ingest_custom_events_total", F.lit("rejected"), none,
              F.col("custom_rejected")),
        entry(ingest & limit.isNotNull(), "ingest_rate_limit_hits_total", limit, none, n),
        entry(ingest & code.isin(*fv.SIGNATURE_FAILURE_CODES), "ingest_signature_failures_total",
              code, none, n),
        entry(ingest & code.isin(*fv.AUTH_FAILURE_CODES), "ingest_auth_failures_total", code,
              none, n),
        entry(~ingest, "analytics_requests_total", F.col("route"), F.col("class"), n),
    )
    flat = cells.select(F.inline(F.array_compact(entries)))
    return (
        flat.groupBy("metric", "label", "second_label")
        .agg(F.sum("value").alias("value"))
        .filter("value > 0")
    )


def latency_histogram(log: DataFrame, labels: list[str], latency_ms: str = "latency_ms") -> DataFrame:
    """Cumulative latency buckets per label set in long form, with count and sum.

    A row is counted once, in the first bucket that holds it; the cumulation runs over the fixed
    bucket list afterwards.
    """
    bounds = [*fv.LATENCY_BUCKETS_S, math.inf]
    counts = [
        F.count_if(F.col(latency_ms) / 1000 <= le).alias(f"_b{i}")
        for i, le in enumerate(fv.LATENCY_BUCKETS_S)
    ]
    totals = log.groupBy(*labels).agg(
        *counts, F.count(F.lit(1)).alias("count"), F.sum(latency_ms).alias("sum_ms")
    )
    names = [str(le) if le != math.inf else "+Inf" for le in bounds]
    values = [F.col(f"_b{i}") for i in range(len(fv.LATENCY_BUCKETS_S))] + [F.col("count")]
    buckets = F.array(
        *[
            F.struct(F.lit(name).alias("le"), value.alias("requests"))
            for name, value in zip(names, values)
        ]
    )
    return totals.select(*labels, F.inline(buckets), "count", "sum_ms")


def latency_quantiles(
    log: DataFrame, labels: list[str], percents: tuple[int, ...] = (50, 95, 99), latency_ms: str = "latency_ms"
) -> DataFrame:
    """Latency per label set below which so many percent of the requests lie, by nearest rank.

    Requests are counted per label set and millisecond in the map tasks, so the ordered pass only
    sees the distinct latencies of a label set.
    """
    counts = log.groupBy(*labels, latency_ms).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*labels)
    upto = whole.orderBy(latency_ms).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select(
        *labels, latency_ms, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_all")
    )

    def least(percent: int) -> Column:
        reached = F.col("_upto") * 100 >= F.col("_all") * percent
        return F.min(F.when(reached, F.col(latency_ms))).alias(f"p{percent}_ms")

    return ranked.groupBy(*labels).agg(F.max("_all").alias("requests"), *[least(p) for p in percents])


def alerts(
    log: DataFrame,
    minutes: int = 5,
    max_error_percent: float = 1.0,
    p95_limit_ms: int = 750,
) -> DataFrame:
    """Share of 5xx answers and p95 breach per service and time window.

    The 95th percentile is above the limit exactly when more than 5 % of the requests are, which
    needs two counts and no sorting.
    """
    window = F.window("received_at", f"{minutes} minutes")
    counts = log.groupBy("service", window.start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.count_if(F.col("latency_ms") > p95_limit_ms).alias("slow"),
    )
    return counts.select(
        "*",
        (F.col("errors") * 100 > F.col("requests") * max_error_percent).alias("error_alert"),
        (F.col("slow") * 20 > F.col("requests")).alias("p95_alert"),
    )


def service_alerts(log: DataFrame, rules: tuple = fv.SERVICE_ALERTS) -> DataFrame:
    """Alerts by service, each with its own measure, threshold and window, in long form.

    A rule counts ``errors`` (answers of 5xx) or ``slow`` requests (above the latency limit) in
    windows of its length; the alert fires when their share is above the threshold. The log is
    reduced to counts per service and minute once, and the windows are sums of those.
    """
    return alerts_of_cells(minute_cells(log, rules, F.date_trunc("minute", "received_at")), rules)


def minute_cells(log: DataFrame, rules: tuple, minute: Column) -> DataFrame:
    """Requests, errors and slow requests per service and minute, of batches and streams."""
    slow_ms = {limit for *_, limit in rules if limit is not None}
    cells = log.groupBy("service", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 500).alias("errors"),
        *[F.count_if(F.col("latency_ms") > ms).alias(f"slow_{ms}") for ms in sorted(slow_ms)],
    )
    return cells


def alerts_of_cells(cells: DataFrame, rules: tuple = fv.SERVICE_ALERTS) -> DataFrame:
    """The alerts of ``service_alerts`` from its counts per service and minute."""
    entries = []
    for service, name, minutes, per_mille, limit in rules:
        start = F.timestamp_seconds(F.floor(F.unix_seconds("minute") / (60 * minutes)) * (60 * minutes))
        entry = F.struct(
            F.lit(name).alias("alert"),
            start.alias("window_start"),
            F.lit(minutes).alias("minutes"),
            F.lit(per_mille).alias("per_mille"),
            F.col("errors" if limit is None else f"slow_{limit}").alias("breaches"),
        )
        entries.append(F.when(F.col("service") == service, entry))
    flat = cells.select("service", "requests", F.inline(F.array_compact(F.array(*entries))))
    sums = flat.groupBy("service", "alert", "window_start", "minutes", "per_mille").agg(
        F.sum("requests").alias("requests"), F.sum("breaches").alias("breaches")
    )
    fires = F.col("breaches") * 1000 > F.col("requests") * F.col("per_mille")
    return sums.withColumn("firing", fires).drop("per_mille")


def refresh_durations(runs: DataFrame) -> DataFrame:
    """Last and longest refresh per table in milliseconds, from rows of ``table_name``,
    ``started_at`` and ``finished_at``."""
    took = F.unix_millis("finished_at") - F.unix_millis("started_at")
    return runs.groupBy("table_name").agg(
        F.max_by(took, "finished_at").alias("last_ms"), F.max(took).alias("longest_ms")
    )


def refresh_lag(tables: DataFrame, as_of: Column, target_s: int) -> DataFrame:
    """Age of each derived table in seconds and whether it is older than the target."""
    lag = F.unix_seconds(as_of) - F.unix_seconds("last_refreshed_at")
    return tables.groupBy("table_name").agg(
        F.max(lag).alias("lag_s"), (F.max(lag) > target_s).alias("lag_alert")
    )


# ---------------------------------------------------------------- rate pressure


def burst_limit(burst_per_minute: int) -> int:
    """Limit of the short window that belongs to a burst rate per minute."""
    share = burst_per_minute * fv.BURST_WINDOW_MS / fv.SUSTAINED_WINDOW_MS
    return max(1, math.ceil(share))


def rate_pressure(
    requests: DataFrame, key: str, per_minute: int, burst_per_minute: int, ts: str = "received_at"
) -> DataFrame:
    """Demand per key and instant in the trailing minute and ten seconds, against both limits.

    Requests are first counted per key and millisecond, in the map tasks. A count is placed in its
    block of ten minutes and, if its minute runs on into the next block, there as history, so an
    ordered pass never spans more than eleven minutes of one key: at most 660,000 rows, whatever
    share of the traffic the key has. Demand is the running sum less the one that ends where the
    trailing window begins; both frames only grow, so a row is added once, however dense a key is.
    """
    width, block_ms = fv.SUSTAINED_WINDOW_MS, 10 * fv.SUSTAINED_WINDOW_MS
    counts = requests.groupBy(key, F.unix_millis(ts).alias("at_ms")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    block = F.floor(F.col("at_ms") / block_ms).cast("bigint")
    runs_on = F.floor((F.col("at_ms") + (width - 1)) / block_ms).cast("bigint")
    placed = counts.withColumn("_block", F.explode(F.array_distinct(F.array(block, runs_on))))
    own = F.col("_block") == block
    ordered = Window.partitionBy(key, "_block").orderBy("at_ms")

    def until(offset: int) -> Column:
        return F.sum("requests").over(ordered.rangeBetween(Window.unboundedPreceding, offset))

    def trailing(ms: int) -> Column:
        return until(0) - F.coalesce(until(-ms), F.lit(0))

    figures = placed.select(
        key,
        "at_ms",
        "requests",
        own.alias("_own"),
        trailing(width).alias("trailing_60s"),
        trailing(fv.BURST_WINDOW_MS).alias("trailing_10s"),
    ).filter("_own")

    def over(trailing_column: str, limit: int) -> Column:
        excess = F.col(trailing_column) - limit
        return F.greatest(F.least(excess, F.col("requests")), F.lit(0)).cast("bigint")

    return figures.drop("_own").select(
        "*",
        over("trailing_60s", per_minute).alias("over_sustained"),
        over("trailing_10s", burst_limit(burst_per_minute)).alias("over_burst"),
    )


# ---------------------------------------------------------------- authentication audit


def timestamp_reasons(requests: DataFrame, window_s: int) -> DataFrame:
    """Add ``time_reason``: bad nonce or timestamp text, or a timestamp outside the window."""
    # Longer digit runs are far outside any window; null arithmetic would hide them.
    signed = F.col("timestamp").try_cast("bigint")
    received = F.unix_seconds("received_at")
    digits = matches(F.col("timestamp"), r"^\d+$")
    late = signed.isNull() | (F.abs(received - signed) > window_s)
    reason = (
        F.when(~F.coalesce(matches(F.col("nonce"), fv.UUID_V4), F.lit(False)), "bad_request")
        .when(~F.coalesce(digits, F.lit(False)), "bad_request")
        .when(late, "timestamp_out_of_window")
    )
    return requests.withColumn("time_reason", reason)


def signature_audit(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``signature_ok``: the request carries the HMAC of timestamp, nonce and body.

    ``keys`` holds key id and key pads.
    """
    joined = with_lookup(requests, keys.select("api_key_id", "ipad", "opad"), "api_key_id")
    message = F.concat_ws("\n", "timestamp", "nonce", "body")
    expected = hmac_sha256_hex(F.col("ipad"), F.col("opad"), message)
    plain = F.regexp_replace(F.translate("signature", "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # 32 bytes are 43 base64 digits and one pad.
    given = F.when(F.length(plain) == 43, F.lower(F.hex(F.unbase64(F.concat(plain, F.lit("="))))))
    ok = F.coalesce(expected == given, F.lit(False))
    return joined.withColumn("signature_ok", ok).drop("ipad", "opad")
