"""From landed requests to stored events.

A request is judged inside its own row: the batch is an array, so batch rules need no shuffle. The
first shuffle is the one on the event id that removes duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from eventlens import fixed_values as fv
from eventlens.config import Settings
from eventlens.functions.scalars import is_custom_name, parse_iso
from eventlens.functions.text import matches
from eventlens.functions.validation import checked_events
from eventlens.operators.joins import with_lookup
from eventlens.sources.tables import append_events, append_staged, staged

STATUS = {
    "rate_limited_ip": 429,
    "rate_limited_key": 429,
    "bad_request": 400,
    "validation_failed": 400,
    "unsupported_schema_version": 400,
    "payload_too_large": 413,
    "unauthorized": 401,
    "signature_invalid": 401,
    "timestamp_out_of_window": 401,
    "replay_detected": 409,
}


def _unsupported(event: Column) -> Column:
    """True for a well-formed schema version of another major."""
    version = event["schema_version"]
    own_major = version.rlike(rf"^0*{fv.SUPPORTED_SCHEMA_MAJOR}\.")
    return F.coalesce(matches(version, fv.MAJOR_MINOR) & ~own_major, F.lit(False))


def parse_body(body: Column) -> Column:
    """A list whose first item is the one JSON value of a body, or null if the body is none or
    anything follows the value.

    The parser stops behind the first value. So the body is parsed as the first item of a list whose
    second item is a digest of the body; text behind the value would take its place or end the list.
    Of a repeated key the last value counts, see ``judge``.
    """
    digest = F.sha2(body, 256)
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), digest, F.lit('"]')))


def judge(requests: DataFrame, keys: DataFrame, settings: Settings) -> DataFrame:
    """Add the checked ``events`` and the reject ``code`` of every request.

    ``keys`` has one row per credential: api_key_id, key_game, enabled. The version gate names the
    first unsupported version in ``unsupported_version``. Requests that the reader has marked as
    ``unreadable`` are bad requests.
    """
    requests.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if "unreadable" not in requests.columns:
        requests = requests.withColumn("unreadable", F.lit(False))
    known = keys.select("api_key_id", "key_game", "enabled")
    listed = with_lookup(requests, known, "api_key_id").withColumn(
        "payload", parse_body(F.col("body"))
    )
    complete = F.coalesce(F.try_variant_get("payload", "$[1]", "string") == F.sha2("body", 256), F.lit(False))
    listed = listed.withColumn("complete", complete)
    variants = F.when(F.col("complete"), F.try_variant_get("payload", "$[0].events", "array<variant>"))
    checked = listed.withColumn("events", checked_events(variants, settings.games))
    gated = checked.withColumn(
        "unsupported_version",
        F.get(F.filter("events", _unsupported), F.lit(0))["schema_version"],
    )
    size_ok = F.size("events").between(fv.BATCH_MIN_EVENTS, fv.BATCH_MAX_EVENTS)
    invalid = F.exists("events", lambda e: F.size(e["reasons"]) > 0)
    other_game = F.exists("events", lambda e: e["game_id"] != F.col("key_game"))
    code = (
        F.when(F.col("unreadable"), "bad_request")
        .when(~F.coalesce(F.col("enabled"), F.lit(False)), "unauthorized")
        .when(~F.col("complete"), "bad_request")
        .when(F.col("unsupported_version").isNotNull(), "unsupported_schema_version")
        .when(~F.coalesce(size_ok, F.lit(False)) | invalid, "validation_failed")
        .when(other_game, "unauthorized")
    )
    return gated.withColumn("code", code).drop("payload", "complete", "key_game", "enabled", "unreadable")


def event_lines(judged: DataFrame, ingest_source: str = fv.DEFAULT_INGEST_SOURCE) -> DataFrame:
    """One row per event with its request's code; values are only filled for accepted events.

    Write the lines before filtering them by code, as ``ingest`` does: the optimizer would move the
    filter below the checks and run them twice.
    """
    lines = judged.select(
        "batch_id", "api_key_id", "received_at", "code", F.posexplode_outer("events").alias("position", "event")
    )
    event = F.col("event")

    def kept(value: Column, name: str) -> Column:
        return F.when(F.col("code").isNull(), value).alias(name)

    names = (
        "event_id",
        "game_id",
        "session_id",
        "player_id_hash",
        "event_name",
        "schema_version",
        "game_version",
        "build_id",
        "platform",
        "locale",
        "consent_analytics",
        "props_json",
    )
    return lines.select(
        "batch_id",
        "position",
        "code",
        event["reasons"].alias("reasons"),
        is_custom_name(event["event_name"]).alias("is_custom"),
        "api_key_id",
        "received_at",
        kept(parse_iso(event["occurred_at"]), "occurred_at"),
        *[kept(event[name], name) for name in names],
        F.lit(ingest_source).alias("ingest_source"),
        F.col("received_at").alias("inserted_at"),
    )


def accepted_events(lines: DataFrame) -> DataFrame:
    return lines.filter("code is null").drop("code", "reasons", "is_custom")


def rejects(lines: DataFrame) -> DataFrame:
    """Refused requests by event position, with rule names and no property values."""
    return lines.filter("code is not null").select("batch_id", "position", "code", "reasons")


def batch_counts(lines: DataFrame) -> DataFrame:
    """Events and custom events per request and code."""
    events = F.count("position")
    return lines.groupBy("batch_id", "code").agg(
        events.alias("event_count"), F.count_if("is_custom").alias("custom_count")
    )


@dataclass(frozen=True)
class IngestReport:
    accepted: int
    rejected_requests: int


def ingest(
    requests: DataFrame,
    keys: DataFrame,
    raw_path: str,
    settings: Settings,
    rejects_path: str | None = None,
    batch_name: str | None = None,
) -> IngestReport:
    """Judge requests, append new events and keep the rejects report.

    The requests are parsed once, into a staged table. The rejects stand in a folder by the name of
    the batch, which is made from its rows unless given. Running the same input again adds no event
    and no reject.
    """
    with staged(event_lines(judge(requests, keys, settings)), "ingest") as lines:
        refused = rejects(lines)
        if rejects_path is not None:
            if batch_name is None:
                row = F.xxhash64("batch_id", "position", "received_at", "code", "reasons")
                total = lines.agg(F.sum(row.cast("decimal(38,0)"))).first()[0] or 0
                batch_name = f"{int(total) % 2**64:016x}"
            refused.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_name}")
        # A request has one line at the first position, or one without any event.
        rejected = refused.agg(F.count_if(F.coalesce("position", F.lit(0)) == 0)).first()[0]
        return IngestReport(append_staged(accepted_events(lines), raw_path), rejected)


def seed(events: DataFrame, raw_path: str, ingest_source: str = "demo_seed") -> int:
    """Append prepared events that arrive when they occur."""
    at = F.col("occurred_at")
    return append_events(
        events.withColumns(
            {"received_at": at, "inserted_at": at, "ingest_source": F.lit(ingest_source)}
        ),
        raw_path,
    )


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Add ``error_code`` and ``status_code`` in the order of the gates.

    Gate columns: ip_limited, content_type, payload_bytes, key_known, time_reason, signature_ok,
    is_replay, key_limited and batch_code, the code of ``judge``.
    """
    json = F.coalesce(F.col("content_type").startswith("application/json"), F.lit(False))
    error = F.coalesce(
        F.when(F.col("ip_limited"), F.lit("rate_limited_ip")),
        F.when(~json, F.lit("bad_request")),
        F.when(F.col("payload_bytes") > fv.BODY_MAX_BYTES, F.lit("payload_too_large")),
        F.when(~F.col("key_known"), F.lit("unauthorized")),
        F.col("time_reason"),
        F.when(~F.col("signature_ok"), F.lit("signature_invalid")),
        F.when(F.col("is_replay"), F.lit("replay_detected")),
        F.when(F.col("key_limited"), F.lit("rate_limited_key")),
        F.col("batch_code"),
    )
    status = F.lit(202)
    for code, number in STATUS.items():
        status = F.when(F.col("error_code") == code, number).otherwise(status)
    return requests.withColumn("error_code", error).withColumn("status_code", status)
