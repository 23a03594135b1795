"""Fixed values of the event contract.

Every list, limit and pattern below is a constant that the results depend on; nothing here is
logic. They are kept together so that a contract change touches one file.
"""

# Event names with a fixed property contract; any other snake_case name is a custom event.
CORE_EVENT_NAMES = (
    "session_start",
    "session_end",
    "match_start",
    "match_end",
    "character_selected",
)
CORE_SCHEMA_VERSION = "1.0"
CUSTOM_SCHEMA_VERSION = "1.1"
SUPPORTED_SCHEMA_MAJOR = 1

PLATFORMS = ("pc", "mac", "linux")
DEFAULT_INGEST_SOURCE = "godot_sdk"

# Envelope patterns and lengths.
SNAKE_CASE = r"^[a-z][a-z0-9_]*$"
MAJOR_MINOR = r"^\d+\.\d+$"
SEMVER = r"^\d+\.\d+\.\d+$"
HEX_64 = r"^[a-f0-9]{64}$"
UUID_ANY = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UUID_V4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
REQUEST_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
EVENT_NAME_MAX = 48
LOCALE_LENGTH = (2, 8)
BUILD_ID_LENGTH = (1, 16)

# Batch, byte and key limits.
BATCH_MIN_EVENTS = 1
BATCH_MAX_EVENTS = 10
EVENT_MAX_BYTES = 2048
PROPERTIES_MAX_BYTES = 1536
CUSTOM_MAX_KEYS = 25
CUSTOM_STRING_MAX = 128
BODY_MAX_BYTES = 1024 * 1024
USER_AGENT_MAX = 120
DEVICE_TAIL_ROWS = 2000
DEVICE_TAIL_BYTES = 2 * 1024 * 1024
SESSION_IDLE_SECONDS = 1800

# Core property contracts: key -> (kind, first bound, second bound) or (kind, allowed values).
CORE_PROPERTIES = {
    "session_start": {
        "launch_reason": ("enum", ("fresh_launch", "resume", "hot_reload")),
        "connection_mode": ("enum", ("online", "offline")),
        "timezone_offset_min": ("int", -720, 840),
    },
    "session_end": {
        "duration_s": ("int", 0, 86400),
        "exit_reason": ("enum", ("user_exit", "disconnect", "crash", "idle_timeout")),
        "xp_earned": ("int", 0, 1000),
    },
    "match_start": {
        "match_id": ("uuid",),
        "mode_id": ("text", 1, 32),
        "map_id": ("text", 1, 32),
        "team_size": ("int", 1, 5),
        "party_size": ("int", 1, 4),
        "mmr_bucket": ("enum", ("bronze", "silver", "gold", "diamond")),
    },
    "match_end": {
        "match_id": ("uuid",),
        "duration_s": ("int", 0, 7200),
        "result": ("enum", ("win", "loss", "draw", "abandon")),
        "character_id": ("text", 1, 32),
        "score": ("int", 0, 100000),
        "damage_dealt": ("int", 0, 500000),
    },
    "character_selected": {
        "selection_context": ("enum", ("match_lobby", "armory", "tutorial")),
        "character_id": ("text", 1, 32),
        "loadout_id": ("optional text", 1, 32),
        "perk_ids": ("optional text list", 5, 1, 32),
        "is_random": ("bool",),
    },
}

# Custom property keys that are always allowed.
GAMEPLAY_KEYS = (
    "build_id",
    "character_id",
    "item_id",
    "level_id",
    "loadout_id",
    "map_id",
    "match_id",
    "mode_id",
    "quest_id",
)

# Custom property keys that are always refused.
SENSITIVE_KEYS = (
    "access_token",
    "address",
    "api_key",
    "auth_token",
    "authorization_header",
    "chat",
    "chat_text",
    "cookie",
    "device_id",
    "email",
    "email_address",
    "error_message",
    "ip",
    "jwt",
    "message",
    "name",
    "password",
    "phone",
    "phone_number",
    "player_id",
    "player_id_hash",
    "player_name",
    "refresh_token",
    "secret",
    "session_id",
    "token",
    "user_name",
    "user_id",
)

# A key that starts with a subject and ends with a suffix is refused too.
SENSITIVE_SUBJECTS = (
    "access",
    "account",
    "api",
    "auth",
    "authorization",
    "device",
    "email",
    "phone",
    "player",
    "profile",
    "refresh",
    "session",
    "user",
)
SENSITIVE_SUFFIXES = ("id", "identifier", "hash", "key", "token", "uuid")

# String values that look like contact data or credentials.
EMAIL_LIKE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
JWT_LIKE = r"^eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
BEARER_LIKE = r"(?i)^bearer\s+\S+$"

# Request gates and metrics.
AUTH_FAILURE_CODES = (
    "signature_invalid",
    "timestamp_out_of_window",
    "replay_detected",
    "token_invalid",
    "token_expired",
    "origin_not_allowed",
)
SIGNATURE_FAILURE_CODES = ("signature_invalid", "timestamp_out_of_window", "replay_detected")
RATE_LIMIT_CODES = {"rate_limited_ip": "ip", "rate_limited_key": "key"}
LATENCY_BUCKETS_S = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
# Alerts: service, name, minutes of the window, threshold in per mille, latency limit in ms (None
# for answers of 5xx). The 95th percentile is above a limit when more than 50 per mille are.
SERVICE_ALERTS = (
    ("ingest", "error_rate", 5, 10, None),
    ("ingest", "latency_p95", 10, 50, 750),
    ("analytics", "error_rate", 10, 5, None),
)
SUSTAINED_WINDOW_MS = 60_000
BURST_WINDOW_MS = 10_000

# Event volume contract of a demo dataset, as (low, high) per rank of the game and core event.
VOLUME_CONTRACT = (
    {
        "session_start": (900, 1200),
        "session_end": (900, 1200),
        "match_start": (700, 900),
        "match_end": (700, 900),
        "character_selected": (1000, 1400),
    },
    {
        "session_start": (600, 900),
        "session_end": (600, 900),
        "match_start": (450, 650),
        "match_end": (450, 650),
        "character_selected": (700, 1000),
    },
)
CONSENT_OFF_PERCENT = (5, 15)

# Allowed query parameters and their defaults.
SESSIONS_DAYS = (7, 14, 30)
SESSIONS_DAYS_DEFAULT = 14
POPULARITY_DAYS = (7, 14)
POPULARITY_DAYS_DEFAULT = 7
RETENTION_WEEKS = (1, 8)
RETENTION_WEEKS_DEFAULT = 8
CUSTOM_DAYS = (1, 30)
CUSTOM_NAMES_DAYS_DEFAULT = 7
CUSTOM_COUNTS_DAYS_DEFAULT = 14
RECENT_LIMIT = (1, 100)
RECENT_LIMIT_DEFAULT = 25
