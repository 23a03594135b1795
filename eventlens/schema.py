"""Schemas of the landed events and of the derived tables."""

from pyspark.sql import types as T

EVENTS_RAW = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("occurred_at", T.TimestampType(), False),
        T.StructField("api_key_id", T.StringType(), False),
        T.StructField("game_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("player_id_hash", T.StringType(), False),
        T.StructField("event_name", T.StringType(), False),
        T.StructField("schema_version", T.StringType(), False),
        T.StructField("game_version", T.StringType(), False),
        T.StructField("build_id", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("locale", T.StringType(), True),
        T.StructField("consent_analytics", T.BooleanType(), False),
        T.StructField("props_json", T.StringType(), False),
        T.StructField("ingest_source", T.StringType(), False),
        T.StructField("inserted_at", T.TimestampType(), False),
    ]
)

# The stored layout also has the partition columns.
EVENTS_STORED = T.StructType(
    [
        *EVENTS_RAW.fields,
        T.StructField("event_date", T.DateType(), True),
        T.StructField("event_group", T.StringType(), True),
    ]
)

# A landed request: one row per POST body.
REQUESTS = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("api_key_id", T.StringType(), True),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("body", T.StringType(), True),
    ]
)

# The columns of a custom event that may leave the private zone.
RECENT_EVENT_COLUMNS = (
    "build_id",
    "consent_analytics",
    "event_id",
    "event_name",
    "game_id",
    "game_version",
    "locale",
    "occurred_at",
    "platform",
    "props_json",
    "received_at",
    "schema_version",
)

# Columns that identify a player, device or credential and must not be in a metric result.
RAW_IDENTIFIERS = ("player_id_hash", "session_id", "api_key_id", "device_id", "user_id")
