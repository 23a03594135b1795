"""The gates of a request from end to end, over a log of requests.

The gates follow each other as they do for a live request: demand of the address, content type, size,
credential, time and nonce, signature, replay, demand of the key, and the events themselves. A gate
only sees what has passed those before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens import fixed_values as fv
from eventlens.config import Settings
from eventlens.functions.scalars import ip_prefix
from eventlens.operators.joins import with_lookup
from eventlens.operators.replay import replay_flags
from eventlens.operators.requests import rate_pressure, signature_audit, timestamp_reasons
from eventlens.plans.ingest import accepted_events, event_lines, judge, request_outcomes
from eventlens.sources.tables import Scratch, append_staged


def over_demand(
    requests: DataFrame, key: str, per_minute: int, burst_per_minute: int, eligible: Column, name: str
) -> DataFrame:
    """Add ``name``: the request is beyond a limit of its key, counting all eligible requests.

    Of the requests of a key and millisecond those with the largest ids are beyond.
    """
    counted = requests.filter(eligible)
    pressure = rate_pressure(counted, key, per_minute, burst_per_minute).select(
        key, "at_ms", F.greatest("over_sustained", "over_burst").alias("_over"), F.col("requests").alias("_n")
    )
    over = pressure.filter("_over > 0")
    instant = Window.partitionBy(key, "at_ms").orderBy("request_id")
    beyond = (
        counted.select("request_id", key, F.unix_millis("received_at").alias("at_ms"))
        .join(over, [key, "at_ms"])
        .withColumn("_rank", F.row_number().over(instant))
        .filter("_rank > _n - _over")
        .select("request_id", F.lit(True).alias(name))
    )
    return requests.join(beyond, "request_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _facts(requests: DataFrame, keys: DataFrame, settings: Settings) -> DataFrame:
    """What the gates need of a request, without its body."""
    known = with_lookup(requests, keys.select("api_key_id", "enabled"), "api_key_id")
    marked = known.withColumns({
        "ip_prefix": ip_prefix(F.col("ip")),
        "payload_bytes": F.coalesce(F.octet_length("body"), F.lit(0)),
        "key_known": F.coalesce("enabled", F.lit(False)),
    })
    signed = timestamp_reasons(signature_audit(marked, keys), settings.replay_window_s)
    return signed.select(
        "request_id", "received_at", "api_key_id", "nonce", "ip_prefix", "content_type",
        "payload_bytes", "key_known", "time_reason", "signature_ok",
    )


def _gated(requests: DataFrame, keys: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The gates before the bodies, and ``admitted``. Each gate reads the written table of the one
    before, so the log itself is read once and no gate is computed twice."""
    facts = scratch.write(_facts(requests, keys, settings))
    limited = scratch.write(over_demand(
        facts, "ip_prefix", settings.ip_per_minute, settings.ip_burst_per_minute, F.lit(True), "ip_limited"
    ))
    json = F.coalesce(F.col("content_type").startswith("application/json"), F.lit(False))
    authentic = (
        ~F.col("ip_limited") & json & (F.col("payload_bytes") <= fv.BODY_MAX_BYTES)
        & F.col("key_known") & F.col("time_reason").isNull() & F.col("signature_ok")
    )
    replay = Scratch(requests.sparkSession, "replay")
    try:
        replayed = scratch.write(replay_flags(limited, settings.replay_window_s, authentic, scratch=replay))
    finally:
        replay.clear()
    fresh = authentic & ~F.col("is_replay")
    pressed = over_demand(
        replayed, "api_key_id", settings.key_per_minute, settings.key_burst_per_minute, fresh, "key_limited"
    )
    return scratch.write(pressed.withColumn("admitted", fresh & ~F.col("key_limited")))


def _landed(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("request_id").alias("batch_id"), "api_key_id", "received_at", "body")


def _judged(requests: DataFrame, gates: DataFrame, keys: DataFrame, settings: Settings) -> DataFrame:
    admitted = gates.filter("admitted").select("request_id")
    return judge(_landed(requests.join(admitted, "request_id", "left_semi")), keys, settings)


def _outcomes(gates: DataFrame, codes: DataFrame) -> DataFrame:
    """``request_id, error_code, status_code`` from the gates and the codes of admitted bodies."""
    codes = codes.select(F.col("batch_id").alias("request_id"), F.col("code").alias("batch_code"))
    outcome = request_outcomes(gates.join(codes, "request_id", "left"))
    return outcome.select("request_id", "error_code", "status_code")


def audit(
    requests: DataFrame, keys: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None
) -> DataFrame:
    """Add ``error_code`` and ``status_code`` to requests with a unique ``request_id``.

    Columns: received_at, ip, content_type, api_key_id, timestamp, nonce, signature and body.
    ``keys`` has one row per credential: api_key_id, key_game, enabled, ipad and opad. Demand counts
    every request that reaches a limit, also refused ones, so it is a lower bound of what passes.
    The tables of the gates are removed; the one of outcomes stays, and with a ``scratch`` the
    caller can remove it.
    """
    scratch = scratch or Scratch(requests.sparkSession, "audit")
    try:
        gates = _gated(requests, keys, settings, scratch)
        found = scratch.write(_outcomes(gates, _judged(requests, gates, keys, settings)))
    except BaseException:
        scratch.clear()
        raise
    scratch.clear(keep=1)
    return requests.drop("error_code", "status_code").join(found, "request_id").select(
        *[c for c in requests.columns if c not in ("error_code", "status_code")], "error_code", "status_code"
    )


def passed(audited: DataFrame) -> DataFrame:
    """The requests that ``ingest`` may take, as landed requests."""
    return _landed(audited.filter("error_code is null"))


@dataclass(frozen=True)
class Admission:
    """Events added, and requests by outcome; ``accepted`` is the outcome without an error."""

    added: int
    requests: dict[str, int]


def admit(requests: DataFrame, keys: DataFrame, raw_path: str, settings: Settings = Settings()) -> Admission:
    """Ingest behind all gates: append the events of the requests that pass, and count outcomes.

    Columns as for ``audit``. A body is parsed once, for its code and for its events.
    """
    scratch = Scratch(requests.sparkSession, "admit")
    try:
        gates = _gated(requests, keys, settings, scratch)
        lines = scratch.write(event_lines(_judged(requests, gates, keys, settings)))
        outcome = _outcomes(gates, lines.select("batch_id", "code").distinct())
        counts = outcome.groupBy(F.coalesce("error_code", F.lit("accepted")).alias("code")).count().collect()
        added = append_staged(accepted_events(lines), raw_path)
    finally:
        scratch.clear()
    return Admission(added, {r["code"]: r["count"] for r in counts})
