"""One query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from checks import data
from checks.data import AS_OF, SETTINGS, SETTINGS_16
from eventlens import fixed_values as fv
from eventlens import streaming
from eventlens.functions import (
    event_schema_version,
    hmac_pads,
    hmac_sha256_hex,
    ip_prefix,
    is_sensitive_key,
    is_unsafe_string,
    iso_utc,
    parse_iso,
    platform_of,
    player_hash,
    request_id_or_new,
    user_agent_label,
    wildcard_match,
)
from eventlens.functions.validation import checked_event
from eventlens.operators import daily, dedupe, quality, replay, requests, retention, sessions
from eventlens.plans import audit, ingest, metrics, refresh, responses
from eventlens.sources import batches, dimensions, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(column)


# ---------------------------------------------------------------- derived tables and metrics


def _sessions_table(spark, sf_dir, settings=SETTINGS_16):
    dates = dimensions.calendar(spark, settings.calendar_start, settings.calendar_end)
    return daily.sessions_daily(data.events(spark, sf_dir), dates, settings.games, settings.k)


def _popularity_table(spark, sf_dir):
    return daily.category_popularity(data.events(spark, sf_dir), SETTINGS.k)


def _summary_table(spark, sf_dir):
    events = data.events(spark, sf_dir)
    return daily.summary_current(events, SETTINGS.games, SETTINGS_16.k, AS_OF)


@query
def sessions_daily_table(spark, sf_dir):
    return _sessions_table(spark, sf_dir)


@query
def sessions_daily_public_all(spark, sf_dir):
    return metrics.sessions_points(_sessions_table(spark, sf_dir), AS_OF)


@query
def sessions_daily_single(spark, sf_dir):
    table = _sessions_table(spark, sf_dir)
    return metrics.sessions_points(table, AS_OF, game="beta", days=30, visibility="private")


@query
def popularity_table(spark, sf_dir):
    return _popularity_table(spark, sf_dir)


@query
def popularity_public(spark, sf_dir):
    return metrics.popularity(_popularity_table(spark, sf_dir), AS_OF)


@query
def popularity_private(spark, sf_dir):
    table = _popularity_table(spark, sf_dir)
    return metrics.popularity(table, AS_OF, game="alpha", days=14, visibility="private")


@query
def popularity_rows(spark, sf_dir):
    table = _popularity_table(spark, sf_dir)
    return metrics.table_rows(table, date(2024, 1, 10), date(2024, 1, 20), game="beta")


@query
def summary_table(spark, sf_dir):
    return _summary_table(spark, sf_dir)


@query
def summary_public_all(spark, sf_dir):
    return metrics.summary(_summary_table(spark, sf_dir))


@query
def summary_private_single(spark, sf_dir):
    return metrics.summary(_summary_table(spark, sf_dir), game="alpha", visibility="private")


@query
def summary_pooled(spark, sf_dir):
    events = data.events(spark, sf_dir)
    return daily.summary_pooled(events, SETTINGS.games, SETTINGS.k, AS_OF)


@query
def retention_daily(spark, sf_dir):
    events = data.events(spark, sf_dir)
    return retention.retention_daily(events, SETTINGS.k, as_of=AS_OF.date())


@query
def retention_weekly(spark, sf_dir):
    table = retention.retention_daily(data.events(spark, sf_dir), SETTINGS.k)
    return metrics.retention_cohorts(table, AS_OF)


@query
def freshness(spark, sf_dir):
    """Earliest refresh and latest arrival, with the fallback for empty input."""
    events = data.events(spark, sf_dir)
    stamped = events.withColumn("last_refreshed_at", F.col("received_at"))
    names = [
        ("metrics", metrics.last_updated(stamped, AS_OF)),
        ("reports", metrics.last_received(events, AS_OF)),
        ("empty", metrics.last_received(events.filter("event_name = 'none'"), AS_OF)),
    ]
    rows = [df.select(F.lit(name).alias("source"), _iso("last_updated")) for name, df in names]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def read_results(spark, sf_dir):
    """Game, window, rows and last update of all seven read results. Derived rows are taken as
    refreshed an hour into their own date."""
    events = data.events(spark, sf_dir)

    def stamped(table, day):
        return table.withColumn("last_refreshed_at", F.col(day).cast("timestamp") + F.expr("interval 1 hour"))

    cohorts = stamped(retention.retention_daily(events, SETTINGS.k), "cohort_date")
    summed = _summary_table(spark, sf_dir).withColumn("last_refreshed_at", F.lit(AS_OF))
    found = {
        "summary": responses.summary(summed, AS_OF),
        "sessions": responses.sessions(stamped(_sessions_table(spark, sf_dir), "metric_date"), AS_OF, days=30),
        "popularity": responses.popularity(stamped(_popularity_table(spark, sf_dir), "metric_date"), AS_OF, "beta"),
        "retention": responses.retention(cohorts, AS_OF, weeks=2),
        "custom_names": responses.custom_names(events, AS_OF),
        "custom_counts": responses.custom_counts(events, "level_end", AS_OF, "alpha"),
        "custom_recent": responses.custom_recent(events, "quest_started", AS_OF, "alpha", limit=10),
    }
    rows = [
        frame.groupBy("game_id", "last_updated").agg(F.count(F.lit(1)).alias("points")).select(
            F.lit(name).alias("metric"), "game_id", "points", _iso("last_updated")
        )
        for name, frame in found.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# ---------------------------------------------------------------- custom events


@query
def custom_names(spark, sf_dir):
    names = metrics.custom_names(data.events(spark, sf_dir), AS_OF)
    return names.select("event_name", "event_count", _iso("first_seen"), _iso("last_seen"))


@query
def custom_counts(spark, sf_dir):
    return metrics.custom_counts(data.events(spark, sf_dir), "level_end", AS_OF, game="alpha")


@query
def custom_recent(spark, sf_dir):
    recent = metrics.custom_recent(data.events(spark, sf_dir), "quest_started", limit=50)
    return recent.select(
        "event_id", "game_id", "props_json", "schema_version", _iso("occurred_at"), _iso("received_at")
    )


# ---------------------------------------------------------------- storage operators


@query
def dedupe_first_wins(spark, sf_dir):
    """Events landed twice, every third copy earlier than the original."""
    events = data.events(spark, sf_dir)
    third = F.col("event_id") % 3 == 0
    shift = F.when(third, F.expr("interval -1 hour")).otherwise(F.expr("interval 1 hour"))
    copies = events.withColumn("received_at", F.col("received_at") + shift)
    first = dedupe.first_per_event(events.unionByName(copies))
    return first.select("event_id", "game_id", _iso("received_at"))


@query
def anti_join_append(spark, sf_dir):
    """Events of a replayed delivery that are not stored yet."""
    events = data.events(spark, sf_dir)
    stored = events.filter(F.col("occurred_at") < F.lit(date(2024, 1, 20)).cast("timestamp"))
    return tables.unseen(events, stored).groupBy("game_id", "event_name").agg(
        F.count(F.lit(1)).alias("added"), F.min("event_id").alias("first_id")
    )


@query
def prune_raw(spark, sf_dir):
    kept = quality.keep_recent(data.events(spark, sf_dir), AS_OF, 14)
    return kept.groupBy("event_name").agg(F.count(F.lit(1)).alias("kept"))


@query
def optout_purge(spark, sf_dir):
    """Events without those of customers with a negative balance, taken as opted out."""
    out = data.table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    ids = F.concat(F.lit("player:"), F.col("c_custkey").cast("string"))
    purged = quality.purge_opted_out(
        data.events(spark, sf_dir), out.select(F.sha2(ids, 256).alias("player_id_hash"))
    )
    return purged.groupBy("game_id", "event_name").agg(F.count(F.lit(1)).alias("events"))


@query
def calendar_missing_dates(spark, sf_dir):
    """Calendar upsert: dates of the order period that no order has filled."""
    orders = data.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    bounds = orders.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    wanted = bounds.select(
        F.explode(F.expr("sequence(first, last + 30, interval 1 day)")).alias("calendar_date")
    )
    return dimensions.new_dates(wanted, orders.select(F.col("day").alias("calendar_date")))


@query
def orphan_matches(spark, sf_dir):
    """Purchases taken as match ends, views as starts, one match per player and day."""
    events = data.events(spark, sf_dir)
    started = F.when(F.col("event_name") == "character_selected", "match_start")
    renamed = events.withColumn("event_name", F.coalesce(started, F.col("event_name")))
    match_id = F.concat_ws(":", "player_id_hash", F.to_date("occurred_at").cast("string"))
    return quality.orphan_matches(renamed, match_id).select("event_id", "game_id")


# ---------------------------------------------------------------- sessions and device queues


@query
def sessionize(spark, sf_dir):
    data.workspace(spark)
    return sessions.sessionize(data.events(spark, sf_dir)).select("event_id", "session_no")


@query
def session_durations(spark, sf_dir):
    data.workspace(spark)
    numbered = sessions.sessionize(data.events(spark, sf_dir), gap_s=6 * 3600)
    return sessions.session_durations(numbered)


@query
def tail_budget(spark, sf_dir):
    data.workspace(spark)
    kept = sessions.tail_budget(
        data.events(spark, sf_dir), "player_id_hash", "props_json", max_rows=30, max_bytes=600
    )
    return kept.select("event_id")


@query
def pack_batches(spark, sf_dir):
    data.workspace(spark)
    packed = sessions.pack_batches(data.events(spark, sf_dir), "player_id_hash")
    return packed.select("event_id", "batch_no", "position")


# ---------------------------------------------------------------- validation


def _checked(spark, sf_dir):
    wire = data.wire_events(spark, sf_dir)
    event = checked_event(F.parse_json("event_json"), SETTINGS.games)
    return wire.select("event_id", event.alias("event"))


@query
def event_validation(spark, sf_dir):
    """Broken rules of every event, in contract order."""
    return _checked(spark, sf_dir).select(
        "event_id", F.array_join("event.reasons", ",").alias("reasons")
    )


@query
def core_strip(spark, sf_dir):
    """Stored properties: unknown keys of core events are gone."""
    stored = F.col("event.props_json")
    return _checked(spark, sf_dir).select(
        "event_id",
        "event.event_name",
        F.octet_length(stored).cast("bigint").alias("property_bytes"),
        F.get_json_object(stored, "$.debug").isNotNull().alias("has_unknown"),
    )


@query
def byte_caps(spark, sf_dir):
    sized = _checked(spark, sf_dir).select(
        "event_id", F.col("event.event_bytes").cast("bigint").alias("event_bytes")
    )
    return sized.withColumn("too_large", F.col("event_bytes") > fv.EVENT_MAX_BYTES)


def _judged(spark, sf_dir):
    return ingest.judge(data.requests(spark, sf_dir), data.credentials(spark), SETTINGS)


@query
def batch_reject(spark, sf_dir):
    """Outcome of every request: one bad event refuses the whole batch."""
    return _judged(spark, sf_dir).select(
        "batch_id", F.coalesce("code", F.lit("accepted")).alias("code")
    )


@query
def batch_counts(spark, sf_dir):
    lines = ingest.event_lines(_judged(spark, sf_dir))
    counts = ingest.batch_counts(lines).withColumn("code", F.coalesce("code", F.lit("accepted")))
    return counts.groupBy("code").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("event_count").alias("events"),
        F.sum("custom_count").alias("custom_events"),
    )


@query
def accepted_events(spark, sf_dir):
    """Events to store. The lines are written before they are filtered, as the ingest job does."""
    data.workspace(spark)
    lines = tables.stage(ingest.event_lines(_judged(spark, sf_dir)), "lines")
    accepted = ingest.accepted_events(lines)
    return accepted.select(
        "event_id", "event_name", "game_id", "locale", "consent_analytics", "position",
        _iso("occurred_at"), F.octet_length("props_json").cast("bigint").alias("property_bytes"),
    )


@query
def sensitive_keys(spark, sf_dir):
    """Property keys made of words and word pairs of the documents, with the attribute names of
    the privacy lists among them where the text has them."""
    docs = data.table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    listed = docs.select("doc_id", words.alias("words"))
    subject = F.element_at(
        F.array(*[F.lit(s) for s in fv.SENSITIVE_SUBJECTS]), (F.col("doc_id") % 13 + 1).cast("int")
    )
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in fv.SENSITIVE_SUFFIXES]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    keys = listed.select(
        "doc_id",
        F.explode("words").alias("word"),
        subject.alias("subject"),
        suffix.alias("suffix"),
    )
    tagged = keys.select(
        "doc_id",
        is_sensitive_key(F.col("word")).cast("int").alias("plain"),
        is_sensitive_key(F.concat_ws("_", "subject", "word", "suffix")).cast("int").alias("joined"),
        is_sensitive_key(F.concat_ws("_", "word", "suffix")).cast("int").alias("suffixed"),
    )
    return tagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("plain").alias("plain"),
        F.sum("joined").alias("joined"),
        F.sum("suffixed").alias("suffixed"),
    )


@query
def unsafe_strings(spark, sf_dir):
    """Words, lines and whole texts of the documents as property values."""
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "text")
    values = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("value"))
    words = values.groupBy("doc_id").agg(
        F.count_if(is_unsafe_string(F.col("value"))).alias("unsafe_words")
    )
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    long = lines.groupBy("doc_id").agg(
        F.count_if(is_unsafe_string(F.col("line"))).alias("unsafe_lines"),
        F.count_if(is_unsafe_string(F.concat(F.lit("Bearer "), F.col("line")))).alias("unsafe_tokens"),
        F.count_if(
            is_unsafe_string(F.concat(F.lit("BEARER\u00a0"), F.replace("line", F.lit(" "), F.lit(""))))
        ).alias("unsafe_wide_tokens"),
    )
    return words.join(long, "doc_id")


# ---------------------------------------------------------------- scalar functions


@query
def ip_prefixes(spark, sf_dir):
    log = data.request_log(spark, sf_dir)
    return log.groupBy(ip_prefix(F.col("ip")).alias("prefix")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query
def player_hashes(spark, sf_dir):
    rows = data.table(spark, sf_dir, "customer")
    seed = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    hashed = player_hash(F.lit("alpha"), F.col("c_name"), seed)
    return rows.select("c_custkey", hashed.alias("player_id_hash"))


@query
def client_labels(spark, sf_dir):
    """Normalised request fields."""
    docs = data.table(spark, sf_dir, "pages")
    os_name = F.concat(
        F.element_at(
            F.array(F.lit("macOS"), F.lit("X-LINUX"), F.lit("Windows")),
            (F.col("page_id") % 3 + 1).cast("int"),
        ),
        F.lit(" 1"),
    )
    name = F.element_at(
        F.array(F.lit("session_end"), F.lit("level_end")), (F.col("page_id") % 2 + 1).cast("int")
    )
    asked = F.concat(F.lit("req-"), F.col("page_id").cast("string"))
    same = request_id_or_new(asked) == asked
    replaced = (F.length(request_id_or_new(F.concat(F.lit("-"), asked))) == 36) & (
        F.length(request_id_or_new(F.concat(asked, F.lit("\n")))) == 36
    )
    face = F.lit("\U0001f600")
    agent = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x" * 119), face, "html"))
        .when(F.col("page_id") % 5 == 1, F.concat(face, "html"))
        .otherwise(F.col("html"))
    )
    return docs.select(
        "page_id",
        user_agent_label(agent).alias("agent"),
        platform_of(os_name).alias("platform"),
        event_schema_version(name).alias("version"),
        wildcard_match(F.col("url"), "http://*page=2&ref=x").alias("allowed"),
        (same & replaced).alias("request_id_ok"),
    )


@query
def iso_round_trip(spark, sf_dir):
    """Event times as ISO text and back lose the fraction of a second and nothing else."""
    events = data.events(spark, sf_dir)
    text = iso_utc(F.col("occurred_at"))
    shifted = F.regexp_replace(text, "Z$", "+02:00")
    return events.select(
        "event_id",
        text.alias("text"),
        (F.unix_seconds(parse_iso(text))).alias("epoch_s"),
        (F.unix_seconds(parse_iso(shifted))).alias("shifted_epoch_s"),
    )


# ---------------------------------------------------------------- request log


@query
def request_counters(spark, sf_dir):
    return requests.request_counters(data.request_log(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    return requests.latency_histogram(data.request_log(spark, sf_dir), ["service", "route"])


@query
def latency_quantiles(spark, sf_dir):
    return requests.latency_quantiles(data.request_log(spark, sf_dir), ["service", "route"])


@query
def alerts_5xx(spark, sf_dir):
    found = requests.alerts(data.request_log(spark, sf_dir))
    return found.select(
        "service", _iso("window_start"), "requests", "errors", "slow", "error_alert", "p95_alert"
    )


@query
def service_alerts(spark, sf_dir):
    found = requests.service_alerts(data.request_log(spark, sf_dir))
    return found.select(
        "service", "alert", _iso("window_start"), "minutes", "requests", "breaches", "firing"
    )


@query
def refresh_lag(spark, sf_dir):
    """Age of each event group at the as-of instant, as if it were a derived table."""
    events = data.events(spark, sf_dir).groupBy(F.col("event_name").alias("table_name")).agg(
        F.max("received_at").alias("last_refreshed_at")
    )
    return requests.refresh_lag(events, F.lit(AS_OF), SETTINGS.freshness_target_s)


@query
def rate_pressure_key(spark, sf_dir):
    return requests.rate_pressure(data.request_log(spark, sf_dir), "api_key_id", 3, 12)


@query
def rate_pressure_ip(spark, sf_dir):
    log = data.request_log(spark, sf_dir).withColumn("ip_prefix", ip_prefix(F.col("ip")))
    return requests.rate_pressure(log, "ip_prefix", 2, 6)


@query
def timestamp_window(spark, sf_dir):
    log = requests.timestamp_reasons(data.request_log(spark, sf_dir), SETTINGS.replay_window_s)
    return log.groupBy(F.coalesce("time_reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query
def replay_flags(spark, sf_dir):
    data.workspace(spark)
    log = requests.timestamp_reasons(data.request_log(spark, sf_dir), SETTINGS.replay_window_s)
    flagged = replay.replay_flags(log, SETTINGS.replay_window_s, F.col("time_reason").isNull())
    return flagged.select("request_id", "is_replay")


@query
def signature_audit(spark, sf_dir):
    """Request lines that carry the hex HMAC of one key; only requests of that key verify."""
    log = data.request_log(spark, sf_dir).withColumn("body", F.col("route"))
    ipad, opad = (F.lit(bytearray(pad)) for pad in hmac_pads(data.SECRETS["key-alpha"]))
    message = F.concat_ws("\n", "timestamp", "nonce", "body")
    sent = F.base64(F.unhex(hmac_sha256_hex(ipad, opad, message)))
    audited = requests.signature_audit(
        log.withColumn("signature", sent), data.signing_keys(spark)
    )
    return audited.select("request_id", "signature_ok", F.length("signature").alias("digits"))


@query
def request_outcome(spark, sf_dir):
    """Outcome of every request when all gates are set from the log."""
    log = requests.timestamp_reasons(data.request_log(spark, sf_dir), SETTINGS.replay_window_s)
    gates = log.select(
        "request_id",
        "time_reason",
        F.expr("error_code <=> 'rate_limited_ip'").alias("ip_limited"),
        F.expr("error_code <=> 'rate_limited_key'").alias("key_limited"),
        F.when(F.expr("latency_ms % 53 = 0"), "text/plain").otherwise("application/json").alias(
            "content_type"
        ),
        F.when(F.expr("latency_ms % 59 = 0"), 2_000_000).otherwise(500).alias("payload_bytes"),
        F.expr("api_key_id <> 'key-4'").alias("key_known"),
        F.expr("not (error_code <=> 'signature_invalid')").alias("signature_ok"),
        F.expr("latency_ms % 31 = 0").alias("is_replay"),
        F.expr("case when error_code = 'validation_failed' then error_code end").alias("batch_code"),
    )
    outcome = ingest.request_outcomes(gates)
    return outcome.select("request_id", "error_code", "status_code")


@query
def request_audit(spark, sf_dir):
    """Outcome of every landed request behind all gates: limits, signatures, replays and bodies."""
    data.workspace(spark)
    log = data.signed_requests(spark, sf_dir)
    audited = audit.audit(log, data.gate_keys(spark), data.GATE_SETTINGS)
    return audited.select("request_id", "error_code", "status_code")


@query
def gated_ingest(spark, sf_dir):
    """Stored events and requests by outcome, when all gates stand before the ingest."""
    raw = f"{_scratch(spark, 'gated')}/events"
    done = audit.admit(data.signed_requests(spark, sf_dir), data.gate_keys(spark), raw, data.GATE_SETTINGS)
    stored = tables.read_events(spark, raw).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    counts = spark.createDataFrame(sorted(done.requests.items()), "item string, n bigint")
    return counts.select(F.lit("requests").alias("source"), "item", "n").unionByName(
        stored.select(F.lit("events").alias("source"), F.col("game_id").alias("item"), "n")
    )


# ---------------------------------------------------------------- data quality


@query
def dataset_checks(spark, sf_dir):
    """The third game has no events."""
    return quality.dataset_checks(data.events(spark, sf_dir), (*SETTINGS.games, "gamma"), AS_OF)


@query
def bucket_checks(spark, sf_dir):
    cohorts = retention.retention_daily(data.events(spark, sf_dir), SETTINGS.k)
    sessions_table = _sessions_table(spark, sf_dir)
    return quality.bucket_checks(sessions_table, _popularity_table(spark, sf_dir), cohorts)


@query
def counts_by_game(spark, sf_dir):
    return quality.counts_by_game(data.events(spark, sf_dir))


@query
def bad_numbers(spark, sf_dir):
    """Sent session lengths that are text are still numbers; invented text is not."""
    events = data.events(spark, sf_dir)
    broken = F.when(F.col("event_id") % 7 == 0, '{"duration_s":"soon"}').when(
        F.col("event_id") % 11 == 0, "{}"
    )
    return quality.bad_numbers(
        events.withColumn("props_json", F.coalesce(broken, "props_json")), "session_end", "duration_s"
    )


@query
def suppressed_share(spark, sf_dir):
    return quality.suppressed_share(_popularity_table(spark, sf_dir), "game_id")


# ---------------------------------------------------------------- jobs and streams


def _scratch(spark, name: str) -> str:
    return f"{data.workspace(spark)}/{name}-{uuid.uuid4().hex}"


def _landed_requests(spark, sf_dir, folder: str) -> str:
    """The requests as JSON line files, in several files for several stream batches."""
    target = f"{folder}/requests"
    data.requests(spark, sf_dir).repartition(4, "batch_id").write.json(target)
    return target


@query
def ingest_job(spark, sf_dir):
    """Batch ingest run twice over the same requests; the second run adds nothing."""
    folder = _scratch(spark, "ingest-job")
    landed = batches.read_requests(spark, _landed_requests(spark, sf_dir, folder))
    raw = f"{folder}/events"
    for _ in range(2):
        ingest.ingest(landed, data.credentials(spark), raw, SETTINGS, f"{folder}/rejects")
    stored = tables.read_events(spark, raw)
    return stored.select("event_id", "event_name", "game_id", "locale", _iso("occurred_at"))


@query
def ingest_rejects(spark, sf_dir):
    """Refused requests by code after two runs over the same files, with the count of the report.

    Beside the landed requests there is an unreadable line for every bad request.
    """
    folder = _scratch(spark, "ingest-rejects")
    path = _landed_requests(spark, sf_dir, folder)
    # Written before the filter, which would else be moved below the checks and run them again.
    bad = tables.stage(_judged(spark, sf_dir).select("batch_id", "code"), "codes").filter("code = 'bad_request'")
    bad.select(F.concat(F.lit("no json "), "batch_id")).write.mode("append").text(path)
    for _ in range(2):
        report = ingest.ingest(
            batches.read_requests(spark, path), data.credentials(spark), f"{folder}/events", SETTINGS, f"{folder}/rejects"
        )
    rejects = spark.read.parquet(f"{folder}/rejects")
    unreadable = F.col("batch_id").startswith("unreadable-") & (F.col("code") == "bad_request")
    code = F.when(unreadable, "unreadable").otherwise(F.col("code"))
    counts = rejects.groupBy(code.alias("code")).agg(F.count_distinct("batch_id").alias("requests"))
    total = spark.range(1).select(F.lit("reported").alias("code"), F.lit(report.rejected_requests).cast("bigint").alias("requests"))
    return counts.unionByName(total)


@query
def stream_ingest(spark, sf_dir):
    """The same requests through the streaming job, one file per batch."""
    folder = _scratch(spark, "stream-ingest")
    source = streaming.request_stream(spark, _landed_requests(spark, sf_dir, folder), max_files=1)
    raw = f"{folder}/events"
    streaming.ingest_stream(
        source, data.credentials(spark), raw, f"{folder}/rejects", f"{folder}/state", SETTINGS
    ).awaitTermination()
    stored = tables.read_events(spark, raw)
    return stored.select("event_id", "event_name", "game_id", "locale", _iso("occurred_at"))


def _storable(spark, sf_dir) -> DataFrame:
    """The adapted events with all columns of the raw table."""
    fixed = {
        "event_id": F.col("event_id").cast("string"),
        "api_key_id": F.lit("key"),
        "game_version": F.lit("0.6.2"),
        "build_id": F.lit("b-1"),
        "platform": F.lit("pc"),
        "locale": F.lit(None).cast("string"),
        "ingest_source": F.lit("godot_sdk"),
        "inserted_at": F.col("received_at"),
    }
    return data.events(spark, sf_dir).withColumns(fixed)


def _stored_events(spark, sf_dir, folder: str) -> str:
    """The adapted events as a landed raw table."""
    raw = f"{folder}/raw"
    tables.append_events(_storable(spark, sf_dir), raw)
    return raw


@query
def stream_sessions_daily(spark, sf_dir):
    """Daily session statistics kept by the streaming job over two landings, the second with late
    events of all dates and of players that the first has counted."""
    folder = _scratch(spark, "stream-sessions")
    raw, target = f"{folder}/raw", f"{folder}/session_days"
    events = _storable(spark, sf_dir)
    late = F.pmod(F.xxhash64("event_id"), F.lit(4)) == 0
    for part in (~late, late):
        tables.append_events(events.filter(part), raw)
        streaming.session_days_stream(spark, raw, target, f"{folder}/state").awaitTermination()
    return streaming.session_days(spark, target)


def _landings(frame: DataFrame, ts: str, parts: int, *closing: DataFrame) -> list[DataFrame]:
    """A frame by ranges of time, then the rows that let the watermark pass all others."""
    edges = frame.agg(F.percentile_approx(F.unix_micros(ts), [k / parts for k in range(1, parts)])).first()[0] or []
    part = sum(((F.unix_micros(ts) > e).cast("int") for e in edges), F.lit(0))
    return [*[frame.filter(part == k) for k in range(parts)], *closing]


def _streamed(landings: list[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each landing is written by as many tasks as its rows have and is one micro-batch of the stream
    that ``start`` makes: the stream runs after each one and goes on where it has ended. Batches
    without rows, which only let state go, wait for the last landing."""
    spark, path = landings[0].sparkSession, f"{folder}/in"
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    try:
        for rows in landings:
            rows.write.mode("append").parquet(path)
            spark.conf.set(setting, before if rows is landings[-1] else "false")
            start(spark.readStream.schema(landings[0].schema).parquet(path)).awaitTermination()
    finally:
        spark.conf.set(setting, before)


def _run(landings: list[DataFrame], folder: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of ``job`` has appended when its input has ended."""
    made: list[DataFrame] = []

    def start(stream: DataFrame) -> StreamingQuery:
        made.append(job(stream))
        query = made[-1].writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state")
        return query.trigger(availableNow=True).format("parquet").start(f"{folder}/out")

    _streamed(landings, folder, start)
    return landings[0].sparkSession.read.schema(made[-1].schema).parquet(f"{folder}/out")


def _later():
    """An instant behind all events."""
    return F.expr("timestamp '2100-01-01 00:00:00'")


@query
def stream_sessions(spark, sf_dir):
    """Numbered sessions of a stream whose events arrive up to an hour out of order."""
    folder = _scratch(spark, "numbered-sessions")
    events = data.events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"), "player_id_hash", "event_name", "occurred_at"
    )
    shift = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(3600)).cast("decimal(18,6)"))
    arriving = events.withColumn("arrived", F.col("occurred_at") + shift)
    last = events.limit(1).withColumns(
        {"player_id_hash": F.lit("~"), "occurred_at": _later(), "arrived": _later()}
    )

    def job(stream: DataFrame) -> DataFrame:
        # An event is numbered by the number in its id where two of a player share an instant.
        padded = stream.withColumn("event_id", F.lpad("event_id", 20, "0"))
        return streaming.numbered_sessions(padded, "2 hours")

    numbered = _run(_landings(arriving, "arrived", 4, last), folder, job)
    return numbered.filter("player_id_hash <> '~'").select(F.col("event_id").cast("bigint").alias("event_id"), "session_no")


@query
def stream_replay(spark, sf_dir):
    """Replay flags of a stream of requests with a state that leaves after the window."""
    folder = _scratch(spark, "stream-replay")
    log = requests.timestamp_reasons(data.request_log(spark, sf_dir), SETTINGS.replay_window_s)
    kept = log.select(F.col("request_id").cast("string").alias("request_id"), "api_key_id", "nonce", "received_at", "time_reason")

    def job(stream: DataFrame) -> DataFrame:
        return streaming.replay_windows(stream, SETTINGS.replay_window_s, "1 hour", F.col("time_reason").isNull())

    flagged = _run(_landings(kept, "received_at", 3), folder, job)
    return flagged.withColumn("request_id", F.col("request_id").cast(log.schema["request_id"].dataType))


@query
def stream_orphans(spark, sf_dir):
    """As ``orphan_matches``, by a stream that waits a day for the starts of an end."""
    folder = _scratch(spark, "stream-orphans")
    events = data.events(spark, sf_dir).select("event_id", "game_id", "player_id_hash", "event_name", "occurred_at")
    started = F.when(F.col("event_name") == "character_selected", "match_start")
    renamed = events.withColumn("event_name", F.coalesce(started, F.col("event_name")))
    ends = [
        renamed.limit(1).withColumns({"player_id_hash": F.lit("~"), "occurred_at": _later(), "event_name": F.lit(name)})
        for name in ("match_start", "match_end")
    ]
    match_id = F.concat_ws(":", "player_id_hash", F.to_date("occurred_at").cast("string"))

    def job(stream: DataFrame) -> DataFrame:
        return streaming.orphan_stream(stream, match_id, "1 hour", "24 hours").select("event_id", "game_id")

    return _run(_landings(renamed, "occurred_at", 3, ends[0].union(ends[1])), folder, job)


@query
def stream_alerts(spark, sf_dir):
    """Service alerts kept by a stream in three batches, the last one with late requests."""
    folder = _scratch(spark, "stream-alerts")
    log = data.request_log(spark, sf_dir).select("service", "received_at", "status_code", "latency_ms")
    late = F.pmod(F.xxhash64("received_at"), F.lit(5)) == 0

    def start(stream: DataFrame) -> StreamingQuery:
        return streaming.alert_stream(stream, f"{folder}/cells", f"{folder}/state", "3650 days")

    _streamed(_landings(log.filter(~late), "received_at", 2, log.filter(late)), folder, start)
    return streaming.live_alerts(spark, f"{folder}/cells").select(
        "service", "alert", _iso("window_start"), "minutes", "requests", "breaches", "firing"
    )


@query
def idle_sessions(spark, sf_dir):
    data.workspace(spark)
    found = streaming.idle_sessions(data.events(spark, sf_dir))
    return found.select("player_id_hash", "event_count", _iso("started_at"), _iso("ended_at"))


@query
def counts_stored(spark, sf_dir):
    """As ``custom_counts``, of a stored table, where row groups of other names are skipped."""
    raw = _stored_events(spark, sf_dir, _scratch(spark, "counts"))
    return metrics.custom_counts(tables.read_events(spark, raw), "level_end", AS_OF, game="alpha")


@query
def recent_stored(spark, sf_dir):
    """Newest events of a stored table, of which only the newest dates are read."""
    raw = _stored_events(spark, sf_dir, _scratch(spark, "recent"))
    recent = metrics.custom_recent(tables.read_events(spark, raw), "level_end", limit=100)
    return recent.select("event_id", "game_id", _iso("occurred_at"))


@query
def offline_events(spark, sf_dir):
    """Events in a client's file, among lines that are no event."""
    folder = _scratch(spark, "offline")
    wire = data.wire_events(spark, sf_dir)
    junk = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("[1]"), F.lit(""), F.lit('{"cut": '))).otherwise(F.array())
    lines = wire.select(F.explode(F.concat(F.array("event_json"), junk)).alias("value"))
    lines.write.text(f"{folder}/events")
    read = batches.read_offline_events(spark, f"{folder}/events")
    return read.select(
        F.try_variant_get("event", "$.event_id", "string").alias("event_id"),
        F.octet_length("line").cast("bigint").alias("bytes"),
    )


@query
def seed_append(spark, sf_dir):
    """Prepared events appended twice; they arrive when they occur."""
    raw = f"{_scratch(spark, 'seed')}/raw"
    added = [ingest.seed(_storable(spark, sf_dir), raw) for _ in range(2)]
    stored = tables.read_events(spark, raw)
    return stored.groupBy("game_id", "ingest_source").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("received_at") == F.col("occurred_at")).alias("on_time"),
    ).withColumns({"first_added": F.lit(added[0]).cast("bigint"), "then_added": F.lit(added[1]).cast("bigint")})


@query
def reset_tables(spark, sf_dir):
    """Raw events and cohorts before and after a reset."""
    folder = _scratch(spark, "reset")
    raw, made = _stored_events(spark, sf_dir, folder), f"{folder}/tables"
    refresh.run_job(spark, "refresh:retention", raw, made, SETTINGS, AS_OF)
    path = f"{made}/retention_cohorts"

    def state(when: str) -> tuple:
        return (when, tables.read_events(spark, raw).count(), tables.latest(spark, path).count())

    before = state("before")
    tables.reset(spark, raw, path, tables.latest(spark, path).limit(0))
    return spark.createDataFrame([before, state("after")], "state string, events bigint, cohorts bigint")


@query
def prune_job(spark, sf_dir):
    """What is left of the stored events when old date partitions are deleted."""
    raw = _stored_events(spark, sf_dir, _scratch(spark, "prune"))
    tables.prune_raw(spark, raw, AS_OF, 14)
    return tables.read_events(spark, raw).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


@query
def refresh_incremental(spark, sf_dir):
    """Two landings, the second with late events, each followed by a refresh; the second refresh
    computes the dates of the second landing alone. All rows of the four published tables."""
    folder = _scratch(spark, "refresh-incremental")
    raw, made = f"{folder}/raw", f"{folder}/tables"
    events = _storable(spark, sf_dir)
    late = (F.pmod(F.col("event_id").cast("bigint"), F.lit(10)) == 3) & F.to_date("occurred_at").between("2024-01-20", "2024-01-24")
    for part in (~late, late):
        tables.append_events(events.filter(part), raw)
        refresh.run_job(spark, "refresh:all", raw, made, SETTINGS_16, AS_OF, incremental=True)
    return _published(spark, made)


def _published(spark, made: str) -> DataFrame:
    """All rows of the four published tables."""
    refresh.register_views(spark, made)
    return spark.sql(
        """
        select 'sessions' as source, game_id, metric_date as day, '' as item, session_count as a,
               active_players as b, avg_session_length_s as c from sessions_daily
        union all
        select 'picks', game_id, metric_date, character_id, pick_count, null, null from character_popularity
        union all
        select 'summary', game_id, null, '', active_players_24h, matches_today, avg_session_length_s_24h
        from metrics_summary_current
        union all
        select 'cohorts', game_id, cohort_date, '', cohort_size, d1_retained, d7_retained
        from retention_cohorts
        """
    )


@query
def prune_then_refresh(spark, sf_dir):
    """As ``refresh_incremental``, with the oldest dates of the raw events deleted after the first
    refresh; a full and an incremental refresh follow. What was derived of deleted dates stays."""
    folder = _scratch(spark, "prune-refresh")
    raw, made = f"{folder}/raw", f"{folder}/tables"
    events = _storable(spark, sf_dir)
    late = (F.pmod(F.col("event_id").cast("bigint"), F.lit(10)) == 3) & F.to_date("occurred_at").between("2024-01-20", "2024-01-24")
    tables.append_events(events.filter(~late), raw)
    refresh.run_job(spark, "refresh:all", raw, made, SETTINGS_16, AS_OF)
    refresh.run_job(spark, "prune:raw", raw, made, SETTINGS_16, AS_OF, days=14)
    refresh.run_job(spark, "refresh:all", raw, made, SETTINGS_16, AS_OF)
    tables.append_events(events.filter(late), raw)
    refresh.run_job(spark, "refresh:all", raw, made, SETTINGS_16, AS_OF, incremental=True)
    return _published(spark, made)


@query
def purge_job(spark, sf_dir):
    """Published cohorts and session days, and what is stored, after some players were deleted."""
    folder = _scratch(spark, "purge")
    raw, made = _stored_events(spark, sf_dir, folder), f"{folder}/tables"
    refresh.run_job(spark, "refresh:all", raw, made, SETTINGS_16, AS_OF)
    players = data.events(spark, sf_dir).select("player_id_hash").distinct()
    gone = players.filter(F.substring("player_id_hash", 1, 1).isin("0", "7", "c"))
    report = refresh.run_job(spark, "purge:players", raw, made, SETTINGS_16, AS_OF, opted_out=gone).first()
    # Events of deleted players that are sent again do not come back.
    again = tables.append_events(_storable(spark, sf_dir), raw)
    stored = tables.read_events(spark, raw)
    rows = stored.groupBy("game_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("player_id_hash").alias("players"))
    refresh.register_views(spark, made)
    kept = spark.sql(
        """select game_id, sum(session_count) as sessions, sum(active_players) as player_days from sessions_daily group by 1"""
    )
    cohorts = spark.sql("select game_id, sum(cohort_size) as cohort_players from retention_cohorts group by 1")
    return rows.join(kept, "game_id").join(cohorts, "game_id").withColumns(
        {"removed": F.lit(report.removed_count), "again": F.lit(again).cast("bigint")}
    )


@query
def refresh_all_job(spark, sf_dir):
    """Land the events, run ``refresh:all`` and read the published tables through SQL views."""
    folder = _scratch(spark, "refresh-all")
    raw = _stored_events(spark, sf_dir, folder)
    refresh.run_job(spark, "refresh:all", raw, f"{folder}/tables", SETTINGS, AS_OF)
    refresh.register_views(spark, f"{folder}/tables")
    return spark.sql(
        """
        select 'sessions' as source, game_id, sum(session_count) as figure
        from sessions_daily group by game_id
        union all
        select 'picks', game_id, sum(pick_count) from character_popularity group by game_id
        union all
        select 'matches', game_id, matches_today from metrics_summary_current
        union all
        select 'cohorts', game_id, sum(cohort_size) from retention_cohorts group by game_id
        """
    )
