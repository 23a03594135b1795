from eventlens.functions.privacy import is_sensitive_key, is_unsafe_string, mask, small_group
from eventlens.functions.scalars import (
    count_text,
    event_schema_version,
    hmac_sha256_hex,
    hmac_pads,
    ip_prefix,
    is_core_name,
    iso_utc,
    parse_iso,
    platform_of,
    player_hash,
    ratio4,
    request_id_or_new,
    request_outcome_label,
    status_class,
    user_agent_label,
    utc_date,
    week_start,
    wildcard_match,
)
from eventlens.functions.validation import checked_event, checked_events

__all__ = [
    "checked_event",
    "checked_events",
    "count_text",
    "event_schema_version",
    "hmac_pads",
    "hmac_sha256_hex",
    "ip_prefix",
    "is_core_name",
    "is_sensitive_key",
    "is_unsafe_string",
    "iso_utc",
    "mask",
    "parse_iso",
    "platform_of",
    "player_hash",
    "ratio4",
    "request_id_or_new",
    "request_outcome_label",
    "small_group",
    "status_class",
    "user_agent_label",
    "utc_date",
    "week_start",
    "wildcard_match",
]
