"""Adapters from the given tables to the library's inputs.

The mappings are SQL expressions that Spark and DuckDB read alike, so both sides of a check start
from the same values. Everything is derived by the engines from the tables.
"""

from __future__ import annotations

import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens import Settings
from eventlens.config import use_utc
from eventlens.functions import hmac_pads, hmac_sha256_hex

AS_OF = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
SETTINGS = Settings()
# Group size that mixes shown and hidden days at the tested scale factors.
SETTINGS_16 = Settings(k=16)

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

EVENT = {
    "event_id": "event_id",
    "event_name": "CASE event_type WHEN 'signup' THEN 'session_start'"
    " WHEN 'click' THEN 'session_end' WHEN 'purchase' THEN 'match_end'"
    " WHEN 'view' THEN 'character_selected'"
    " ELSE CASE WHEN k % 3 = 0 THEN 'quest_started' ELSE 'level_end' END END",
    "schema_version": "CASE WHEN event_type = 'error' THEN '1.1' ELSE '1.0' END",
    "game_id": "CASE WHEN user_id % 3 = 0 THEN 'beta' ELSE 'alpha' END",
    "consent_analytics": "event_id % 10 <> 0",
    "duration_s": "CAST(floor(value * 10) AS BIGINT)",
    "character_id": "CASE WHEN k < 45 THEN 'warden' WHEN k < 70 THEN 'oracle'"
    " WHEN k < 85 THEN 'ranger' WHEN k < 95 THEN 'mystic' ELSE 'trickster' END",
}
PROPS = (
    "CASE event_name WHEN 'session_end'"
    """ THEN '{"duration_s":' || CAST(duration_s AS STRING) || '}'"""
    " WHEN 'character_selected'"
    """ THEN '{"character_id":"' || character_id || '"}'"""
    """ ELSE '{"level_id":"forest_' || CAST(k AS STRING) || '"}' END"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is set only where none is configured."""
    from eventlens.sources.tables import shared_folder

    try:
        return shared_folder(spark)
    except RuntimeError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventlens-"))
        return shared_folder(spark)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events of the library from the ``events`` table."""
    source = table(spark, sf_dir, "events").withColumn("k", F.expr(K))
    mapped = source.select(
        "k",
        "user_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        *[F.expr(sql).alias(name) for name, sql in EVENT.items()],
    )
    at = F.col("occurred_at")
    user = F.col("user_id").cast("string")
    session = F.concat(F.lit("s:"), user, F.lit(":"), F.date_format(at, "yyyy-MM-dd"))
    return mapped.select(
        "event_id",
        (at + F.expr("interval 5 seconds")).alias("received_at"),
        "occurred_at",
        "game_id",
        F.substring(F.sha2(session, 256), 1, 32).alias("session_id"),
        F.sha2(F.concat(F.lit("player:"), user), 256).alias("player_id_hash"),
        "event_name",
        "schema_version",
        "consent_analytics",
        F.expr(PROPS).alias("props_json"),
    )


# ---------------------------------------------------------------- requests with event batches

_MD5 = "md5('{0}' || CAST(event_id AS STRING))"


def _uuid(prefix: str) -> str:
    h = _MD5.format(prefix)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({h}, {start}, {length})" for start, length in parts)


# Names as sent: some session starts are sent as match starts.
WIRE_NAME = (
    f"CASE WHEN event_type = 'signup' AND k % 4 = 1 THEN 'match_start' ELSE {EVENT['event_name']} END"
)


def _newline(n: int, also: str = "TRUE") -> str:
    """A newline, as JSON text, behind the value of a few events."""
    return f"CASE WHEN event_id % 229 = {n} AND {also} THEN chr(92) || 'n' ELSE '' END"


# Field values before JSON quoting. Rare values break one rule each.
WIRE = {
    "nl_id": _newline(1),
    "nl_name": _newline(2, "event_type = 'error'"),
    "nl_version": _newline(3),
    "nl_at": _newline(4),
    "nl_session": _newline(5),
    "nl_player": _newline(6),
    "nl_game_version": _newline(7),
    "block": "CAST(floor(event_id / 20) AS BIGINT)",
    "uuid": _uuid("e:"),
    "session_uuid": _uuid("s:"),
    "wire_version": "CASE WHEN event_id % 211 = 0 THEN '2.0' WHEN event_type <> 'error' THEN '1.0'"
    " WHEN k = 15 THEN '1.0' ELSE '1.1' END",
    "wire_zone": "CASE WHEN event_id % 193 = 0 THEN '' ELSE 'Z' END",
    "wire_game": "CASE WHEN event_id % 191 = 0 THEN 'gamma' WHEN user_id % 3 = 0 THEN 'beta'"
    " ELSE 'alpha' END",
    "wire_build": "CASE WHEN event_id % 181 = 0 THEN '' ELSE 'b-' || CAST(k AS STRING) END",
    "wire_platform": "CASE WHEN event_id % 173 = 0 THEN 'ps5' WHEN k % 3 = 0 THEN 'mac' ELSE 'pc' END",
    "wire_locale": "CASE WHEN event_id % 151 = 0 THEN ',\"locale\":\"x\"' WHEN k % 2 = 0"
    " THEN ',\"locale\":\"pt-BR\"' ELSE '' END",
    "wire_consent": "CASE WHEN event_id % 197 = 0 THEN '\"true\"' WHEN event_id % 10 = 0 THEN 'false'"
    " ELSE 'true' END",
    "kt": "CAST(k AS STRING)",
}

# Properties as JSON text: the known keys, and the text behind them that only core events lose.
WIRE_PROPS = {
    "session_start": """'{"launch_reason":"' || CASE k % 3 WHEN 0 THEN 'fresh_launch' WHEN 1
        THEN 'resume' ELSE 'hot_reload' END || '","connection_mode":"online","timezone_offset_min":'
        || CAST(k * 16 - 720 AS STRING)""",
    "match_start": """'{"match_id":"' || session_uuid || CASE WHEN k = 41 THEN chr(92) || 'n' ELSE '' END ||
        '","mode_id":"' || CASE WHEN k = 53 THEN '' ELSE 'duo' END || '","map_id":"dunes","team_size":' ||
        CASE WHEN k = 49 THEN '6' ELSE '2' END || ',"party_size":1,"mmr_bucket":"' ||
        CASE WHEN k = 45 THEN 'mythic' ELSE 'silver' END || '"'""",
    "session_end": """'{"duration_s":' || CASE WHEN k = 51 THEN '"12"' ELSE
        CAST(k * 10 AS STRING) END || ',"exit_reason":"' || CASE WHEN k = 50 THEN 'rage_quit' ELSE
        'user_exit' END || '","xp_earned":' || CASE WHEN k = 52 THEN '1.5' ELSE kt END""",
    "match_end": """'{"match_id":"' || session_uuid || '","duration_s":' || CAST(k * 72 AS STRING) ||
        ',"result":"win","character_id":"' || CASE WHEN k = 53 THEN '' ELSE 'warden' END ||
        '","score":' || CAST(k * 1000 AS STRING) || ',"damage_dealt":' || CAST(k * 5060 AS STRING)""",
    "character_selected": """'{"selection_context":"armory","character_id":"oracle","perk_ids":["a"' ||
        CASE WHEN k = 77 THEN ',"b","c","d","e","f"' ELSE ',"b"' END || '],"is_random":' ||
        CASE WHEN k = 78 THEN '1' ELSE 'true' END""",
}
MANY_KEYS = "".join(f',"extra_{i}":{i}' for i in range(24))
WIRE_CUSTOM = """'{"level_id":"forest_' || kt || '","tier":' || kt ||
    CASE k WHEN 33 THEN ',"player_id":"p"' WHEN 34 THEN ',"badKey":1' WHEN 66 THEN
    ',"contact":"a@b.co"' WHEN 67 THEN ',"extra":{"x":1}' WHEN 68 THEN ',"extra":null' WHEN 69 THEN
    ',"extra":[["a"]]' WHEN 44 THEN ',"tags":["' || repeat('x', 128) || '"' || repeat(',"' ||
    repeat('y', 128) || '"', 11) || ']' WHEN 35 THEN '""" + MANY_KEYS + """' WHEN 36 THEN
    ',"email' || chr(92) || 'n":1' WHEN 38 THEN ',"note":"bearer' || chr(160) || 'abcdef"' ELSE '' END"""
WIRE_STRIPPED = (
    "CASE event_name "
    + " ".join(f"WHEN '{name}' THEN {sql} || '}}'" for name, sql in WIRE_PROPS.items())
    + f" ELSE {WIRE_CUSTOM} || '}}' END"
)
# Core events carry one more key, which is not part of the contract.
WIRE_SENT = (
    "CASE event_name "
    + " ".join(f"WHEN '{name}' THEN {sql} || ',\"debug\":1}}'" for name, sql in WIRE_PROPS.items())
    + f" ELSE {WIRE_CUSTOM} || '}}' END"
)
WIRE_ENVELOPE = """'{"event_id":"' || uuid || nl_id || '","event_name":"' || event_name || nl_name ||
    '","schema_version":"' || wire_version || nl_version || '","occurred_at":"' || at_text || wire_zone ||
    nl_at || '","session_id":"' || session_uuid || nl_session || '","player_id_hash":"' ||
    player_id_hash || nl_player || '","game_id":"' || wire_game || '","game_version":"0.6.2' ||
    nl_game_version || '","build_id":"' || wire_build ||
    '","platform":"' || wire_platform || '"' || wire_locale || ',"consent_analytics":' ||
    wire_consent || ',"properties":'"""

REQUEST = {
    "batch_id": "CASE WHEN user_id % 3 = 0 THEN 'beta-' ELSE 'alpha-' END || CAST(block AS STRING)"
    " || CASE WHEN block % 13 = 0 THEN '' ELSE '-' ||"
    " CAST(CAST(floor(event_id % 20 / 10) AS BIGINT) AS STRING) END",
    "api_key_id": "CASE WHEN block % 31 = 7 THEN 'key-old' WHEN block % 17 = 3 THEN 'key-alpha'"
    " WHEN user_id % 3 = 0 THEN 'key-beta' ELSE 'key-alpha' END",
    "cut": "block % 29 = 5",
    "junk": "block % 37 = 11",
    "twice": "block % 41 = 7",
}


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the JSON text that a client would send, with its request."""
    source = table(spark, sf_dir, "events").withColumn("k", F.expr(K))
    named = source.select(
        "*",
        F.expr(WIRE_NAME).alias("event_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at_text"),
        F.sha2(F.concat(F.lit("player:"), F.col("user_id").cast("string")), 256).alias(
            "player_id_hash"
        ),
    )
    fields = named.select("*", *[F.expr(sql).alias(name) for name, sql in WIRE.items()])
    return fields.select(
        "*",
        *[F.expr(sql).alias(name) for name, sql in REQUEST.items()],
        F.expr(f"{WIRE_ENVELOPE} || {WIRE_SENT} || '}}'").alias("event_json"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed requests: batches of up to 20 events; some texts are cut, have more text behind the
    object, or name the events twice, of which the last counts."""
    grouped = (
        wire_events(spark, sf_dir)
        .groupBy("batch_id", "api_key_id", "cut", "junk", "twice")
        .agg(
            F.sort_array(F.collect_list(F.struct("event_id", "event_json"))).alias("sent"),
            F.max("ts").cast("timestamp").alias("received_at"),
        )
    )
    items = F.array_join(F.transform("sent", lambda e: e["event_json"]), ",")
    begin = F.when(F.col("twice"), '{"events":[{"event_id":"none"}],"events":[').otherwise('{"events":[')
    end = F.when(F.col("cut"), "").when(F.col("junk"), "]} {}").otherwise("]}")
    return grouped.select(
        "batch_id", "api_key_id", "received_at", F.concat(begin, items, end).alias("body")
    )


def credentials(spark: SparkSession) -> DataFrame:
    rows = [("key-alpha", "alpha", True), ("key-beta", "beta", True), ("key-old", "alpha", False)]
    return spark.createDataFrame(rows, "api_key_id string, key_game string, enabled boolean")


# ---------------------------------------------------------------- request log

LOG = {
    "request_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||"
    " CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' ||"
    " substr(CAST(l_shipdate AS STRING), 1, 10)",
    "offset_ms": "(l_orderkey * 7919 + l_linenumber * 13007) % 600000",
    "api_key_id": "CASE WHEN l_suppkey % 5 < 2 THEN 'key-alpha' ELSE 'key-' ||"
    " CAST(l_suppkey % 5 AS STRING) END",
    "service": "CASE WHEN l_linestatus = 'O' THEN 'ingest' ELSE 'analytics' END",
    "route": "CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber = 1 THEN '/health' ELSE"
    " '/events' END WHEN l_partkey % 3 = 0 THEN '/metrics/summary' ELSE '/metrics/sessions/daily' END",
    "status_code": "CASE WHEN l_partkey % 61 = 0 THEN 500 WHEN l_partkey % 23 = 0 THEN 429"
    " WHEN l_partkey % 19 = 0 THEN 401 WHEN l_partkey % 17 = 0 THEN 400"
    " WHEN l_linestatus = 'O' AND l_linenumber <> 1 THEN 202 ELSE 200 END",
    "error_code": "CASE WHEN l_partkey % 61 = 0 THEN 'internal_error' WHEN l_partkey % 23 = 0 THEN"
    " CASE WHEN l_partkey % 2 = 0 THEN 'rate_limited_ip' ELSE 'rate_limited_key' END"
    " WHEN l_partkey % 19 = 0 THEN CASE l_partkey % 4 WHEN 0 THEN 'signature_invalid' WHEN 1 THEN"
    " 'timestamp_out_of_window' WHEN 2 THEN 'token_expired' ELSE 'unauthorized' END"
    " WHEN l_partkey % 17 = 0 THEN 'validation_failed' END",
    "latency_ms": "CAST(floor(l_extendedprice / 9) AS BIGINT) % 1200 + CASE WHEN l_partkey % 50 = 0"
    " THEN 10000 ELSE 0 END",
    "events_written": "CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) % 11 ELSE 0 END",
    "custom_accepted": "CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) % 4 ELSE 0 END",
    "custom_rejected": "CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 0 END",
    "ip": "CASE l_suppkey % 4 WHEN 0 THEN '10.' || CAST(l_suppkey % 7 AS STRING) || '.' ||"
    " CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 256 AS STRING)"
    " || CASE WHEN l_partkey % 97 = 3 THEN chr(10) ELSE '' END"
    " WHEN 1 THEN '::ffff:192.168.' || CAST(l_suppkey % 9 AS STRING) || '.7'"
    " WHEN 2 THEN '2001:0DB8:00' || CAST(10 + l_suppkey % 80 AS STRING) || '::8a2e:' ||"
    " CAST(l_linenumber AS STRING) ELSE 'host-' || CAST(l_suppkey AS STRING) END",
    # A few nonces are shared by very many requests.
    "nonce_key": "CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 2 ELSE l_orderkey % 5000 END",
    "skew_s": "l_partkey % 640 - 320",
    # Broken texts: a newline behind the nonce or the timestamp, and a nonce of another version.
    "nonce_head": "CASE WHEN l_orderkey % 103 = 5 THEN '5b1d7a90-33c2-1f08-a6e4-'"
    " ELSE '5b1d7a90-33c2-4f08-a6e4-' END",
    "nonce_tail": "CASE WHEN l_orderkey % 101 = 7 THEN chr(10) ELSE '' END",
    "time_tail": "CASE WHEN l_orderkey % 107 = 9 THEN chr(10) ELSE '' END",
}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from ``lineitem``: one request per line, minutes apart on the ship date."""
    lines = table(spark, sf_dir, "lineitem")
    mapped = lines.select("l_shipdate", *[F.expr(sql).alias(name) for name, sql in LOG.items()])
    millis = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("offset_ms")
    received = F.timestamp_millis(millis)
    nonce = F.concat(
        F.col("nonce_head"), F.lpad(F.col("nonce_key").cast("string"), 12, "0"), F.col("nonce_tail")
    )
    return mapped.select(
        "*",
        received.alias("received_at"),
        nonce.alias("nonce"),
        F.concat((F.unix_seconds(received) + F.col("skew_s")).cast("string"), F.col("time_tail")).alias("timestamp"),
    )


SECRETS = {"key-alpha": "alpha-secret", "key-2": "two", "key-3": "three" * 20}


def signing_keys(spark: SparkSession) -> DataFrame:
    rows = [(key, *map(bytearray, hmac_pads(secret))) for key, secret in SECRETS.items()]
    return spark.createDataFrame(rows, "api_key_id string, ipad binary, opad binary")


# ---------------------------------------------------------------- signed requests

# Header fields of a landed request, by the number in its id. Times are a few seconds apart, so that
# all limits are met; some nonces are shared by requests of minutes.
NUMBER = "CAST(regexp_extract(batch_id, '([0-9]+)', 1) AS INT)"
HEADER = {
    "at_ms": "1706616000000 + CAST(n AS BIGINT) * 1500",
    "ip": "'10.0.' || CAST(n % 3 AS STRING) || '.9'",
    "content_type": "CASE WHEN n % 43 = 1 THEN 'text/plain' ELSE 'application/json' END",
    "nonce": "'5b1d7a90-33c2-4f08-a6e4-' || CASE WHEN n % 4 = 0 THEN lpad(CAST(n % 40 AS STRING), 12, '0')"
    " ELSE substr(md5(batch_id), 1, 12) END || CASE WHEN n % 67 = 9 THEN chr(10) ELSE '' END",
    "skew_s": "CASE WHEN n % 23 = 6 THEN 400 ELSE n % 200 - 100 END",
    "forged": "n % 37 = 2",
    "padded": "n % 211 = 4",
}
GATE_SECRETS = {"key-alpha": "alpha-secret", "key-beta": "beta" * 20, "key-old": "old"}
GATE_SETTINGS = Settings(ip_per_minute=54, ip_burst_per_minute=66, key_per_minute=30, key_burst_per_minute=48)


def gate_keys(spark: SparkSession) -> DataFrame:
    rows = [(key, *map(bytearray, hmac_pads(secret))) for key, secret in GATE_SECRETS.items()]
    return credentials(spark).join(spark.createDataFrame(rows, "api_key_id string, ipad binary, opad binary"), "api_key_id")


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed requests with their headers; forged ones are signed for another body."""
    numbered = requests(spark, sf_dir).withColumn("n", F.expr(NUMBER))
    headed = numbered.select("*", *[F.expr(sql).alias(name) for name, sql in HEADER.items()])
    spaces = F.when(F.col("padded"), F.repeat(F.lit(" "), F.lit(1_100_000))).otherwise("")
    timed = headed.withColumns({
        "timestamp": (F.expr("at_ms div 1000") + F.col("skew_s")).cast("string"),
        "body": F.concat("body", spaces),
    })
    message = F.concat_ws("\n", "timestamp", "nonce", F.when(F.col("forged"), "other").otherwise(F.col("body")))
    digest = F.lit(None).cast("string")
    for key, secret in GATE_SECRETS.items():
        ipad, opad = (F.lit(bytearray(pad)) for pad in hmac_pads(secret))
        digest = F.when(F.col("api_key_id") == key, hmac_sha256_hex(ipad, opad, message)).otherwise(digest)
    return timed.select(
        F.col("batch_id").alias("request_id"), F.timestamp_millis("at_ms").alias("received_at"), "ip",
        "content_type", "api_key_id", "timestamp", "nonce", F.base64(F.unhex(digest)).alias("signature"), "body",
    )
