"""SQL counterparts of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from checks import data
from eventlens import fixed_values as fv

_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())


EV = f"""
WITH keyed AS (SELECT *, {data.K} AS k FROM events),
mapped AS (
  SELECT k, user_id, ts AS occurred_at, ts + INTERVAL 5 SECOND AS received_at,
         {_columns(data.EVENT)}
  FROM keyed
),
ev AS (
  SELECT *, sha256('player:' || user_id) AS player_id_hash, CAST(occurred_at AS DATE) AS day,
         {data.PROPS} AS props_json
  FROM mapped
)"""

# Half-up integer mean, and ratio with four places, both in integers.
MEAN = "COALESCE((2 * SUM(duration_s) + COUNT(*)) // (2 * COUNT(*)), 0)"


def _ratio(n: str, d: str) -> str:
    return (
        f"CASE WHEN {d} = 0 THEN 0.0 ELSE ((20000 * CAST({n} AS BIGINT) + CAST({d} AS BIGINT))"
        f" // (2 * CAST({d} AS BIGINT))) / CAST(10000.0 AS DOUBLE) END"
    )


def _sessions(k: int) -> str:
    return f"""{EV},
stats AS (
  SELECT day AS metric_date, game_id, COUNT(*) AS n, COUNT(DISTINCT player_id_hash) AS p,
         {MEAN} AS m
  FROM ev WHERE event_name = 'session_end' AND consent_analytics GROUP BY 1, 2
),
spine AS (
  SELECT CAST(d AS DATE) AS metric_date, g.game_id
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY) t(d)
  CROSS JOIN (VALUES ('alpha'), ('beta')) g(game_id)
),
sessions AS (
  SELECT metric_date, game_id, CAST(COALESCE(n, 0) AS BIGINT) AS session_count,
         CAST(COALESCE(p, 0) AS BIGINT) AS active_players,
         CAST(COALESCE(m, 0) AS BIGINT) AS avg_session_length_s,
         COALESCE(p, 0) BETWEEN 1 AND {k - 1} AS suppressed
  FROM spine LEFT JOIN stats USING (metric_date, game_id)
)"""


POPULARITY = f"""{EV},
totals AS (
  SELECT day AS metric_date, game_id, character_id, COUNT(*) AS pick_count,
         COUNT(DISTINCT player_id_hash) AS players
  FROM ev WHERE event_name = 'character_selected' AND consent_analytics GROUP BY 1, 2, 3
),
popularity AS (
  SELECT metric_date, game_id, character_id, pick_count,
         CAST(pick_count AS DOUBLE) /
           CAST(SUM(pick_count) OVER (PARTITION BY metric_date, game_id) AS DOUBLE) AS pick_ratio,
         players BETWEEN 1 AND 9 AS suppressed
  FROM totals
)"""

SUMMARY = f"""{EV},
ended AS (
  SELECT game_id, COUNT(DISTINCT player_id_hash) AS p, {MEAN} AS m, SUM(duration_s) AS s,
         COUNT(*) AS n
  FROM ev WHERE event_name = 'session_end' AND consent_analytics
    AND occurred_at >= {_AS_OF} - INTERVAL 24 HOUR GROUP BY 1
),
matches AS (
  SELECT game_id, COUNT(*) AS n, COUNT(DISTINCT player_id_hash) AS p
  FROM ev WHERE event_name = 'match_end' AND consent_analytics AND day = DATE '2024-01-30' GROUP BY 1
),
summary AS (
  SELECT g.game_id, CAST(COALESCE(e.p, 0) AS BIGINT) AS active_players_24h,
         CAST(COALESCE(t.n, 0) AS BIGINT) AS matches_today,
         CAST(COALESCE(e.m, 0) AS BIGINT) AS avg_session_length_s_24h,
         COALESCE(e.p, 0) BETWEEN 1 AND 15 AS suppressed_active_players,
         COALESCE(t.p, 0) BETWEEN 1 AND 15 AS suppressed_matches_today,
         COALESCE(e.p, 0) BETWEEN 1 AND 15 AS suppressed_avg_session_length
  FROM (VALUES ('alpha'), ('beta')) g(game_id)
  LEFT JOIN ended e ON e.game_id = g.game_id LEFT JOIN matches t ON t.game_id = g.game_id
)"""

RETENTION = f"""{EV},
days AS (
  SELECT DISTINCT game_id, player_id_hash, day FROM ev
  WHERE event_name = 'session_start' AND consent_analytics
),
firsts AS (SELECT game_id, player_id_hash, MIN(day) AS first FROM days GROUP BY 1, 2),
members AS (
  SELECT f.game_id, f.first,
         MAX(CASE WHEN d.day = f.first + 1 THEN 1 ELSE 0 END) AS d1,
         MAX(CASE WHEN d.day = f.first + 7 THEN 1 ELSE 0 END) AS d7
  FROM firsts f JOIN days d USING (game_id, player_id_hash) GROUP BY 1, 2, f.player_id_hash
),
cohorts AS (
  SELECT first AS cohort_date, game_id, COUNT(*) AS cohort_size,
         CAST(SUM(d1) AS BIGINT) AS d1_retained, CAST(SUM(d7) AS BIGINT) AS d7_retained
  FROM members GROUP BY 1, 2
)"""

WIRE_EVENT = f"""
WITH keyed AS (SELECT *, {data.K} AS k FROM events),
named AS (
  SELECT *, {data.WIRE_NAME} AS event_name,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at_text,
         sha256('player:' || user_id) AS player_id_hash
  FROM keyed
),
fields AS (SELECT *, {_columns(data.WIRE)} FROM named),
wire AS (
  SELECT *, {_columns(data.REQUEST)},
         {data.WIRE_STRIPPED} AS stripped
  FROM fields
),
sized AS (
  SELECT *, strlen(stripped) AS property_bytes,
         strlen({data.WIRE_ENVELOPE}) + strlen(stripped) + 1 AS event_bytes
  FROM wire
)"""

# Broken rules, written from the known contents of the sent values.
_REASONS = [
    ("event_id", "nl_id <> ''"),
    ("event_name", "nl_name <> ''"),
    ("schema_version", "nl_version <> ''"),
    ("occurred_at", "wire_zone = '' OR nl_at <> ''"),
    ("session_id", "nl_session <> ''"),
    ("player_id_hash", "nl_player <> ''"),
    ("game_id", "wire_game NOT IN ('alpha', 'beta')"),
    ("game_version", "nl_game_version <> ''"),
    ("build_id", "length(wire_build) NOT BETWEEN 1 AND 16"),
    ("platform", "wire_platform NOT IN ('pc', 'mac', 'linux')"),
    ("locale", "event_id % 151 = 0"),
    ("consent_analytics", "event_id % 197 = 0"),
    ("properties.timezone_offset_min", "event_name = 'session_start' AND k * 16 - 720 > 840"),
    ("properties.match_id", "event_name = 'match_start' AND k = 41"),
    ("properties.mode_id", "event_name = 'match_start' AND k = 53"),
    ("properties.team_size", "event_name = 'match_start' AND k = 49"),
    ("properties.mmr_bucket", "event_name = 'match_start' AND k = 45"),
    ("properties.duration_s", "event_name = 'session_end' AND k = 51"),
    ("properties.exit_reason", "event_name = 'session_end' AND k = 50"),
    ("properties.xp_earned", "event_name = 'session_end' AND k = 52"),
    ("properties.character_id", "event_name = 'match_end' AND k = 53"),
    ("properties.damage_dealt", "event_name = 'match_end' AND k * 5060 > 500000"),
    ("properties.perk_ids", "event_name = 'character_selected' AND k = 77"),
    ("properties.is_random", "event_name = 'character_selected' AND k = 78"),
    ("schema_version", "event_type = 'error' AND wire_version <> '1.1' AND nl_version = ''"),
    ("properties.count", "event_type = 'error' AND k = 35"),
    ("properties.key", "event_type = 'error' AND k IN (33, 34, 36)"),
    ("properties.value", "event_type = 'error' AND k IN (38, 66, 67, 68, 69)"),
    ("event.bytes", "event_bytes > 2048"),
    ("properties.bytes", "property_bytes > 1536"),
]
WIRE = f"""{WIRE_EVENT},
checked AS (
  SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _REASONS)}) AS reasons
  FROM sized
),
judged AS (
  SELECT batch_id,
         CASE WHEN ANY_VALUE(api_key_id) = 'key-old' THEN 'unauthorized'
              WHEN ANY_VALUE(cut) OR ANY_VALUE(junk) THEN 'bad_request'
              WHEN BOOL_OR(wire_version = '2.0' AND nl_version = '') THEN 'unsupported_schema_version'
              WHEN COUNT(*) > 10 OR BOOL_OR(reasons <> '') THEN 'validation_failed'
              WHEN BOOL_OR('key-' || wire_game <> api_key_id) THEN 'unauthorized'
              ELSE 'accepted' END AS code,
         BOOL_OR(cut OR junk) AS cut, COUNT(*) AS n,
         CAST(SUM(CASE WHEN event_type = 'error' AND nl_name = '' THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM checked GROUP BY batch_id
)"""

_LOG_COLUMNS = _columns({n: sql for n, sql in data.LOG.items()})
LOG = f"""
WITH mapped AS (SELECT l_shipdate, l_suppkey, {_LOG_COLUMNS} FROM lineitem),
log AS (
  SELECT *, l_shipdate + to_milliseconds(offset_ms) AS received_at,
         epoch_ms(l_shipdate) + offset_ms AS at_ms,
         nonce_head || lpad(CAST(nonce_key AS VARCHAR), 12, '0') || nonce_tail AS nonce,
         CASE WHEN nonce_head <> '5b1d7a90-33c2-4f08-a6e4-' OR nonce_tail <> '' OR time_tail <> ''
              THEN 'bad_request' WHEN abs(skew_s) > 300 THEN 'timestamp_out_of_window' END AS time_reason
  FROM mapped
)"""

IP_PREFIX = """CASE l_suppkey % 4
    WHEN 0 THEN CASE WHEN l_partkey % 97 = 3 THEN 'unknown' ELSE
      '10.' || (l_suppkey % 7) || '.' || l_linenumber || '.0/24' END
    WHEN 1 THEN '192.168.' || (l_suppkey % 9) || '.0/24'
    WHEN 2 THEN '2001:db8:' || (10 + l_suppkey % 80) || '::/48'
    ELSE 'unknown' END"""


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


# White space of the contract: ASCII, no-break and the other Unicode spaces, line separators, BOM.
_SPACE = (
    "\\x{9}-\\x{D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
)


def _unsafe(value: str) -> str:
    return (
        f"(length({value}) + length(regexp_replace({value}, '[\\x{{0000}}-\\x{{FFFF}}]', '', 'g'))"
        f" > {fv.CUSTOM_STRING_MAX}"
        f" OR regexp_matches({value}, '^[^{_SPACE}@]+@[^{_SPACE}@]+\\.[^{_SPACE}@]+$')"
        f" OR regexp_matches({value}, '^eyJ[A-Za-z0-9_-]*\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+$')"
        f" OR regexp_matches({value}, '^[Bb][Ee][Aa][Rr][Ee][Rr][{_SPACE}]+[^{_SPACE}]+$'))"
    )


def _sensitive(key: str) -> str:
    def quoted(names):
        return ", ".join(f"'{n}'" for n in names)

    pairs = " OR ".join(
        f"{key} = '{s}_{x}' OR (starts_with({key}, '{s}_') AND ends_with({key}, '_{x}'))"
        for s in fv.SENSITIVE_SUBJECTS
        for x in fv.SENSITIVE_SUFFIXES
    )
    return (
        f"({key} NOT IN ({quoted(fv.GAMEPLAY_KEYS)}) AND"
        f" ({key} IN ({quoted(fv.SENSITIVE_KEYS)}) OR {pairs}))"
    )


def _pressure(key: str, source: str, per_minute: int, burst: int) -> str:
    return f"""{source},
counts AS (SELECT {key}, at_ms, COUNT(*) AS requests FROM keyed GROUP BY 1, 2),
demand AS (
  SELECT *, CAST(SUM(requests) OVER (PARTITION BY {key} ORDER BY at_ms
              RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_60s,
         CAST(SUM(requests) OVER (PARTITION BY {key} ORDER BY at_ms
              RANGE BETWEEN 9999 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_10s
  FROM counts
)
SELECT {key}, at_ms, requests, trailing_60s, trailing_10s,
       GREATEST(LEAST(trailing_60s - {per_minute}, requests), 0) AS over_sustained,
       GREATEST(LEAST(trailing_10s - {burst}, requests), 0) AS over_burst
FROM demand"""


def _beyond(name: str, source: str, key: str, eligible: str, per_minute: int, burst_per_minute: int) -> str:
    """CTEs that add ``name`` to ``source``: the request is beyond a limit of its key."""
    burst = max(1, -(-burst_per_minute * 10 // 60))

    def trailing(ms: int) -> str:
        return f"SUM(COUNT(*)) OVER (PARTITION BY {key} ORDER BY at_ms RANGE BETWEEN {ms - 1} PRECEDING AND CURRENT ROW)"

    return f"""{name}_demand AS (
  SELECT {key}, at_ms, COUNT(*) AS here, {trailing(60000)} AS in_60s, {trailing(10000)} AS in_10s
  FROM {source} WHERE {eligible} GROUP BY 1, 2
),
{name}_ranked AS (
  SELECT request_id, ROW_NUMBER() OVER (PARTITION BY {key}, at_ms ORDER BY request_id)
           > here - GREATEST(LEAST(in_60s - {per_minute}, here), LEAST(in_10s - {burst}, here), 0) AS {name}
  FROM {source} JOIN {name}_demand USING ({key}, at_ms) WHERE {eligible}
),
{name}_rows AS (
  SELECT s.*, COALESCE(r.{name}, FALSE) AS {name} FROM {source} s LEFT JOIN {name}_ranked r USING (request_id)
)"""


def _audited() -> str:
    limits = data.GATE_SETTINGS
    ip = _beyond("ip_limited", "facts", "ip", "TRUE", limits.ip_per_minute, limits.ip_burst_per_minute)
    key = _beyond(
        "key_limited", "replayed", "api_key_id", "authentic AND NOT is_replay",
        limits.key_per_minute, limits.key_burst_per_minute,
    )
    return f"""
WITH RECURSIVE {WIRE.strip().removeprefix("WITH")},
owners AS (SELECT batch_id, ANY_VALUE(api_key_id) AS api_key_id FROM checked GROUP BY 1),
numbered AS (
  SELECT batch_id, batch_id AS request_id, code AS body_code, api_key_id, {data.NUMBER} AS n
  FROM judged JOIN owners USING (batch_id)
),
headed AS (SELECT *, {_columns(data.HEADER)} FROM numbered),
facts AS (
  SELECT *, CASE WHEN n % 67 = 9 THEN 'bad_request' WHEN abs(skew_s) > 300 THEN 'timestamp_out_of_window' END AS time_reason
  FROM headed
),
{ip},
signed AS (
  SELECT *, NOT ip_limited AND content_type = 'application/json' AND NOT padded AND api_key_id <> 'key-old'
            AND time_reason IS NULL AND NOT forged AS authentic
  FROM ip_limited_rows
),
instants AS (
  SELECT api_key_id, nonce, at_ms, MIN(request_id) AS first_id FROM signed WHERE authentic GROUP BY 1, 2, 3
),
opened AS (
  SELECT api_key_id, nonce, MIN(at_ms) AS at_ms FROM instants GROUP BY 1, 2
  UNION ALL
  SELECT o.api_key_id, o.nonce, MIN(i.at_ms) FROM opened o JOIN instants i USING (api_key_id, nonce)
  WHERE i.at_ms >= o.at_ms + 300000 GROUP BY 1, 2
),
accepted AS (SELECT first_id FROM opened JOIN instants USING (api_key_id, nonce, at_ms)),
replayed AS (
  SELECT *, authentic AND request_id NOT IN (SELECT first_id FROM accepted) AS is_replay FROM signed
),
{key},
coded AS (
  SELECT *, CASE
    WHEN ip_limited THEN 'rate_limited_ip'
    WHEN content_type <> 'application/json' THEN 'bad_request'
    WHEN padded THEN 'payload_too_large'
    WHEN api_key_id = 'key-old' THEN 'unauthorized'
    WHEN time_reason IS NOT NULL THEN time_reason
    WHEN forged THEN 'signature_invalid'
    WHEN is_replay THEN 'replay_detected'
    WHEN key_limited THEN 'rate_limited_key'
    WHEN body_code <> 'accepted' THEN body_code END AS error_code
  FROM key_limited_rows
)"""


def _sessionized(gap_s: int) -> str:
    return f"""{EV},
gaps AS (
  SELECT *, LAG(occurred_at) OVER w AS before FROM ev
  WINDOW w AS (PARTITION BY player_id_hash ORDER BY occurred_at, event_id)
),
numbered AS (
  SELECT *, CAST(SUM(CASE WHEN before IS NULL OR event_name = 'session_start'
                          OR epoch_us(occurred_at) - epoch_us(before) >= CAST({gap_s} AS BIGINT) * 1000000
                     THEN 1 ELSE 0 END)
            OVER (PARTITION BY player_id_hash ORDER BY occurred_at, event_id) AS BIGINT) AS session_no
  FROM gaps
)"""


def _hmac_sql(secret: str) -> str:
    from eventlens.functions import hmac_pads

    ipad, opad = ("".join(f"\\x{b:02X}" for b in pad) for pad in hmac_pads(secret))
    message = "encode(concat_ws(chr(10), CAST(signed AS VARCHAR) || time_tail, nonce, route))"
    return f"sha256('{opad}'::BLOB || unhex(sha256('{ipad}'::BLOB || {message})))"


def _counters() -> str:
    ingest = "service = 'ingest'"
    outcome = (
        "COALESCE(error_code, CASE WHEN route = '/events' AND status_code = 202 THEN 'accepted'"
        " ELSE 'ok' END)"
    )
    cls = "(status_code // 100) || 'xx'"

    def in_list(codes):
        return "error_code IN ({})".format(", ".join(f"'{c}'" for c in codes))

    parts = [
        ("ingest_requests_total", cls, outcome, "COUNT(*)", ingest),
        ("ingest_events_written_total", "'godot_sdk'", "''", "SUM(events_written)", ingest),
        ("ingest_custom_events_total", "'accepted'", "''", "SUM(custom_accepted)", ingest),
        ("ingest_custom_events_total", "'rejected'", "''", "SUM(custom_rejected)", ingest),
        (
            "ingest_rate_limit_hits_total",
            "replace(error_code, 'rate_limited_', '')",
            "''",
            "COUNT(*)",
            f"{ingest} AND {in_list(fv.RATE_LIMIT_CODES)}",
        ),
        (
            "ingest_signature_failures_total",
            "error_code",
            "''",
            "COUNT(*)",
            f"{ingest} AND {in_list(fv.SIGNATURE_FAILURE_CODES)}",
        ),
        (
            "ingest_auth_failures_total",
            "error_code",
            "''",
            "COUNT(*)",
            f"{ingest} AND {in_list(fv.AUTH_FAILURE_CODES)}",
        ),
        ("analytics_requests_total", "route", cls, "COUNT(*)", "service = 'analytics'"),
    ]
    selects = [
        f"SELECT '{metric}' AS metric, {label} AS label, {second} AS second_label,"
        f" CAST({value} AS BIGINT) AS value FROM log WHERE {where} GROUP BY 1, 2, 3"
        for metric, label, second, value, where in parts
    ]
    return f"{LOG} " + " UNION ALL ".join(selects)


def _histogram() -> str:
    rows = [
        f"SELECT service, route, '{le}' AS le, COUNT(*) FILTER (latency_ms <= {round(le * 1000)})"
        " AS requests, COUNT(*) AS count, CAST(SUM(latency_ms) AS BIGINT) AS sum_ms"
        " FROM log GROUP BY 1, 2"
        for le in fv.LATENCY_BUCKETS_S
    ]
    rows.append(
        "SELECT service, route, '+Inf', COUNT(*), COUNT(*), CAST(SUM(latency_ms) AS BIGINT)"
        " FROM log GROUP BY 1, 2"
    )
    return f"{LOG} " + " UNION ALL ".join(rows)


STORED = f"""{WIRE}
SELECT uuid AS event_id, event_name, wire_game AS game_id,
       CASE WHEN k % 2 = 0 THEN 'pt-BR' END AS locale,
       {_iso("date_trunc('second', ts)")} AS occurred_at
FROM checked JOIN judged USING (batch_id) WHERE code = 'accepted'"""


def _dataset_checks() -> str:
    checks = [
        ("consent_off_share", "off", "off * 100 BETWEEN n * 5 AND n * 15 AND n > 0"),
        ("session_days", "session_days", "session_days >= 14"),
        ("weekly_cohorts", "weekly_cohorts", "weekly_cohorts >= 8"),
        ("fresh_events", "fresh", "fresh >= 1"),
    ]
    for name in fv.CORE_EVENT_NAMES:
        ranges = " ".join(
            f"WHEN '{game}' THEN {name} BETWEEN {r[name][0]} AND {r[name][1]}"
            for game, r in zip(data.SETTINGS.games, fv.VOLUME_CONTRACT)
        )
        checks.append((f"volume_{name}", name, f"COALESCE(CASE game_id {ranges} END, FALSE)"))
    names = ", ".join(
        f"COUNT(*) FILTER (event_name = '{n}') AS {n}" for n in fv.CORE_EVENT_NAMES
    )
    selects = " UNION ALL ".join(
        f"SELECT game_id, '{check}' AS \"check\", CAST({value} AS BIGINT) AS value, {ok} AS ok FROM t"
        for check, value, ok in checks
    )
    filled = ", ".join(
        f"COALESCE({c}, 0) AS {c}"
        for c in ("off", "n", "session_days", "weekly_cohorts", "fresh", *fv.CORE_EVENT_NAMES)
    )
    return f"""{EV},
firsts AS (
  SELECT game_id, player_id_hash, MIN(day) AS first FROM ev
  WHERE event_name = 'session_start' AND consent_analytics GROUP BY 1, 2
),
cohorts AS (
  SELECT game_id, COUNT(DISTINCT date_trunc('week', first)) AS weekly_cohorts FROM firsts GROUP BY 1
),
found AS (
  SELECT game_id, {names}, COUNT(*) AS n, COUNT(*) FILTER (NOT consent_analytics) AS off,
         COUNT(*) FILTER (occurred_at >= {_AS_OF} - INTERVAL 15 MINUTE) AS fresh,
         COUNT(DISTINCT CASE WHEN event_name = 'session_end' AND consent_analytics THEN day END)
           AS session_days
  FROM ev GROUP BY 1
),
t AS (
  SELECT game_id, {filled} FROM (VALUES ('alpha'), ('beta'), ('gamma')) g(game_id)
  LEFT JOIN found USING (game_id) LEFT JOIN cohorts USING (game_id)
)
{selects}"""


def all_oracles() -> dict[str, str]:
    sessions16 = _sessions(16)
    last14 = "metric_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'"
    last7 = "metric_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"
    points = ("session_count", "active_players", "avg_session_length_s")
    hidden = ", ".join(
        f"CASE WHEN NOT BOOL_OR(suppressed) THEN CAST(SUM({n}) AS BIGINT) END AS {n}" for n in points
    )
    shown = ", ".join(f"CAST(SUM({n}) AS BIGINT) AS {n}" for n in points)
    figures = {
        "active_players": ("active_players_24h", "suppressed_active_players"),
        "avg_session_length_s": ("avg_session_length_s_24h", "suppressed_avg_session_length"),
        "matches_today": ("matches_today", "suppressed_matches_today"),
    }
    public_summary = ", ".join(
        f"CASE WHEN NOT BOOL_OR({flag}) THEN CAST(SUM({value}) AS BIGINT) END AS {name},"
        f" BOOL_OR({flag}) AS {name}_suppressed"
        for name, (value, flag) in figures.items()
    )
    private_summary = ", ".join(
        f"{value} AS {name}, FALSE AS {name}_suppressed" for name, (value, _) in figures.items()
    )
    d1, d7 = _ratio("d1_retained", "cohort_size"), _ratio("d7_retained", "cohort_size")
    sub = ", ".join(f"'{s}'" for s in fv.SENSITIVE_SUBJECTS)
    suf = ", ".join(f"'{s}'" for s in fv.SENSITIVE_SUFFIXES)
    key_case = " ".join(
        f"WHEN '{key}' THEN {_hmac_sql(secret)}" for key, secret in data.SECRETS.items()
    )
    alpha_hmac = _hmac_sql(data.SECRETS["key-alpha"])
    found = {
        "sessions_daily_table": f"{sessions16} SELECT * FROM sessions",
        "sessions_daily_public_all": f"""{sessions16}
SELECT metric_date, {hidden}, BOOL_OR(suppressed) AS suppressed
FROM sessions WHERE {last14} GROUP BY 1""",
        "sessions_daily_single": f"""{sessions16}
SELECT metric_date, {shown}, FALSE AS suppressed FROM sessions
WHERE game_id = 'beta' AND metric_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1""",
        "popularity_table": f"{POPULARITY} SELECT * FROM popularity",
        "popularity_public": f"""{POPULARITY},
merged AS (
  SELECT CASE WHEN suppressed THEN 'other' ELSE character_id END AS character_id, suppressed,
         SUM(pick_count) AS picks
  FROM popularity WHERE {last7} GROUP BY 1, 2
),
total AS (SELECT SUM(picks) AS t FROM merged)
SELECT character_id, CASE WHEN NOT suppressed THEN CAST(picks AS BIGINT) END AS pick_count,
       {_ratio("picks", "t")} AS pick_ratio, suppressed
FROM merged, total""",
        "popularity_private": f"""{POPULARITY},
merged AS (
  SELECT character_id, SUM(pick_count) AS picks FROM popularity
  WHERE {last14} AND game_id = 'alpha' GROUP BY 1
),
total AS (SELECT SUM(picks) AS t FROM merged)
SELECT character_id, CAST(picks AS BIGINT) AS pick_count, {_ratio("picks", "t")} AS pick_ratio,
       FALSE AS suppressed
FROM merged, total""",
        "popularity_rows": f"""{POPULARITY}
SELECT * FROM popularity
WHERE metric_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND game_id = 'beta'""",
        "summary_table": f"{SUMMARY} SELECT * FROM summary",
        "summary_public_all": f"{SUMMARY} SELECT 'all' AS game_id, {public_summary} FROM summary",
        "summary_private_single": f"""{SUMMARY}
SELECT game_id, {private_summary} FROM summary WHERE game_id = 'alpha'""",
        "summary_pooled": f"""{SUMMARY}
SELECT 'all' AS game_id, CAST(SUM(e.p) AS BIGINT) AS active_players_24h,
       CAST(SUM(t.n) AS BIGINT) AS matches_today,
       CAST((2 * SUM(e.s) + SUM(e.n)) // (2 * SUM(e.n)) AS BIGINT) AS avg_session_length_s_24h,
       SUM(e.p) BETWEEN 1 AND 9 AS suppressed_active_players,
       SUM(t.p) BETWEEN 1 AND 9 AS suppressed_matches_today
FROM ended e FULL JOIN matches t USING (game_id)""",
        "retention_daily": f"""{RETENTION}
SELECT *, {d1} AS d1_retention_pct, d1_retained > 0 AND d1_retained < 10 AS d1_suppressed,
       {d7} AS d7_retention_pct, d7_retained > 0 AND d7_retained < 10 AS d7_suppressed,
       cohort_date + 1 < DATE '2024-01-30' AS d1_mature,
       cohort_date + 7 < DATE '2024-01-30' AS d7_mature
FROM cohorts""",
        "retention_weekly": f"""{RETENTION},
weekly AS (
  SELECT CAST(date_trunc('week', cohort_date) AS DATE) AS cohort_date,
         CAST(SUM(cohort_size) AS BIGINT) AS cohort_size,
         CAST(SUM(d1_retained) AS BIGINT) AS d1_retained,
         CAST(SUM(d7_retained) AS BIGINT) AS d7_retained
  FROM cohorts WHERE cohort_date BETWEEN DATE '2023-12-11' AND DATE '2024-01-30' GROUP BY 1
)
SELECT cohort_date, cohort_size,
       CASE WHEN d1_retained NOT BETWEEN 1 AND 9 THEN d1_retained END AS d1_retained,
       {d1} AS d1_retention_pct, d1_retained BETWEEN 1 AND 9 AS d1_suppressed,
       CASE WHEN d7_retained NOT BETWEEN 1 AND 9 THEN d7_retained END AS d7_retained,
       {d7} AS d7_retention_pct, d7_retained BETWEEN 1 AND 9 AS d7_suppressed
FROM weekly""",
        "freshness": f"""{EV}
SELECT 'metrics' AS source, {_iso("MIN(received_at)")} AS last_updated FROM ev
UNION ALL SELECT 'reports', {_iso("MAX(received_at)")} FROM ev
UNION ALL SELECT 'empty', {_iso(_AS_OF)}""",
        "custom_names": f"""{EV}
SELECT event_name, COUNT(*) AS event_count, {_iso("MIN(occurred_at)")} AS first_seen,
       {_iso("MAX(occurred_at)")} AS last_seen
FROM ev WHERE event_name IN ('quest_started', 'level_end') AND consent_analytics
  AND day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1""",
        "custom_counts": f"""{EV},
counts AS (
  SELECT day, COUNT(*) AS n FROM ev
  WHERE event_name = 'level_end' AND consent_analytics AND game_id = 'alpha' GROUP BY 1
)
SELECT CAST(d AS DATE) AS metric_date, COALESCE(n, 0) AS event_count
FROM generate_series(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(d)
LEFT JOIN counts ON day = CAST(d AS DATE)""",
        "custom_recent": f"""{EV}
SELECT event_id, game_id, props_json, schema_version, {_iso("occurred_at")} AS occurred_at,
       {_iso("received_at")} AS received_at
FROM ev WHERE event_name = 'quest_started' AND consent_analytics
ORDER BY ev.occurred_at DESC, event_id LIMIT 50""",
        "dedupe_first_wins": f"""{EV}
SELECT event_id, game_id, {_iso("CASE WHEN event_id % 3 = 0 THEN received_at - INTERVAL 1 HOUR ELSE received_at END")} AS received_at
FROM ev""",
        "anti_join_append": f"""{EV}
SELECT game_id, event_name, COUNT(*) AS added, MIN(event_id) AS first_id
FROM ev WHERE event_id NOT IN (SELECT event_id FROM ev WHERE occurred_at < TIMESTAMP '2024-01-20')
GROUP BY 1, 2""",
        "prune_raw": f"""{EV}
SELECT event_name, COUNT(*) AS kept FROM ev
WHERE occurred_at >= {_AS_OF} - INTERVAL 14 DAY GROUP BY 1""",
        "optout_purge": f"""{EV}
SELECT game_id, event_name, COUNT(*) AS events FROM ev
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2""",
        "calendar_missing_dates": """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(d AS DATE) AS calendar_date
FROM generate_series((SELECT CAST(MIN(day) AS TIMESTAMP) FROM days),
                     (SELECT CAST(MAX(day) + 30 AS TIMESTAMP) FROM days), INTERVAL 1 DAY) t(d)
WHERE CAST(d AS DATE) NOT IN (SELECT day FROM days)""",
        "orphan_matches": f"""{EV}
SELECT event_id, game_id FROM ev e
WHERE event_name = 'match_end' AND NOT EXISTS (
  SELECT 1 FROM ev s WHERE s.event_name = 'character_selected' AND s.user_id = e.user_id
    AND s.day = e.day AND s.occurred_at <= e.occurred_at)""",
        "sessionize": f"{_sessionized(1800)} SELECT event_id, session_no FROM numbered",
        "session_durations": f"""{_sessionized(6 * 3600)}
SELECT player_id_hash, session_no, COUNT(*) AS event_count,
       CAST(floor(epoch_us(MAX(occurred_at)) / 1000000) - floor(epoch_us(MIN(occurred_at)) / 1000000)
            AS BIGINT) AS duration_s
FROM numbered GROUP BY 1, 2""",
        "tail_budget": f"""{EV},
ranked AS (
  SELECT event_id, ROW_NUMBER() OVER w AS n, SUM(strlen(props_json) + 1) OVER w AS b FROM ev
  WINDOW w AS (PARTITION BY player_id_hash ORDER BY occurred_at DESC, event_id DESC)
)
SELECT event_id FROM ranked WHERE n <= 30 AND b <= 600""",
        "pack_batches": f"""{EV},
ranked AS (
  SELECT event_id, ROW_NUMBER() OVER (PARTITION BY player_id_hash ORDER BY occurred_at, event_id) - 1
    AS i FROM ev
)
SELECT event_id, i // 10 AS batch_no, CAST(i % 10 AS INT) AS position FROM ranked""",
        "event_validation": f"{WIRE} SELECT event_id, reasons FROM checked",
        "core_strip": f"""{WIRE_EVENT}
SELECT event_id, event_name || CASE WHEN nl_name <> '' THEN chr(10) ELSE '' END AS event_name,
       property_bytes, FALSE AS has_unknown FROM sized""",
        "byte_caps": f"""{WIRE_EVENT}
SELECT event_id, event_bytes, event_bytes > 2048 AS too_large FROM sized""",
        "batch_reject": f"{WIRE} SELECT batch_id, code FROM judged",
        "batch_counts": f"""{WIRE}
SELECT code, COUNT(*) AS requests,
       CAST(SUM(CASE WHEN cut THEN 0 ELSE n END) AS BIGINT) AS events,
       CAST(SUM(CASE WHEN cut THEN 0 ELSE c END) AS BIGINT) AS custom_events
FROM judged GROUP BY 1""",
        "accepted_events": f"""{WIRE}
SELECT uuid AS event_id, event_name, wire_game AS game_id,
       CASE WHEN k % 2 = 0 THEN 'pt-BR' END AS locale, event_id % 10 <> 0 AS consent_analytics,
       CAST(ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY checked.event_id) - 1 AS INT) AS position,
       {_iso("date_trunc('second', ts)")} AS occurred_at, property_bytes
FROM checked JOIN judged USING (batch_id) WHERE code = 'accepted'""",
        "sensitive_keys": f"""
WITH keys AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))
           AS word,
         list_extract([{sub}], CAST(doc_id % 13 + 1 AS INT)) AS subject,
         list_extract([{suf}], CAST(doc_id % 6 + 1 AS INT)) AS suffix
  FROM documents
),
named AS (
  SELECT doc_id, word, subject || '_' || word || '_' || suffix AS joined,
         word || '_' || suffix AS suffixed
  FROM keys
)
SELECT doc_id, COUNT(*) AS keys, COUNT(*) FILTER ({_sensitive("word")}) AS plain,
       COUNT(*) FILTER ({_sensitive("joined")}) AS joined,
       COUNT(*) FILTER ({_sensitive("suffixed")}) AS suffixed
FROM named GROUP BY 1""",
        "unsafe_strings": f"""
WITH words AS (
  SELECT doc_id, COUNT(*) FILTER ({_unsafe("value")}) AS unsafe_words
  FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS value FROM documents) GROUP BY 1
),
lines AS (
  SELECT doc_id, COUNT(*) FILTER ({_unsafe("line")}) AS unsafe_lines,
         COUNT(*) FILTER ({_unsafe("token")}) AS unsafe_tokens,
         COUNT(*) FILTER ({_unsafe("wide_token")}) AS unsafe_wide_tokens
  FROM (SELECT doc_id, line, 'Bearer ' || line AS token,
               'BEARER' || chr(160) || replace(line, ' ', '') AS wide_token
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1
)
SELECT * FROM words JOIN lines USING (doc_id)""",
        "ip_prefixes": f"""
SELECT {IP_PREFIX} AS prefix, COUNT(*) AS requests FROM lineitem GROUP BY 1""",
        "player_hashes": """
SELECT c_custkey, sha256('alpha::' || c_name || '::' ||
       CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END) AS player_id_hash
FROM customer""",
        "client_labels": """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN repeat('x', 119) || chr(65533)
         WHEN 1 THEN chr(128512) || substr(html, 1, 118) ELSE substr(html, 1, 120) END AS agent,
       CASE page_id % 3 WHEN 0 THEN 'mac' WHEN 1 THEN 'linux' ELSE 'pc' END AS platform,
       CASE page_id % 2 WHEN 0 THEN '1.0' ELSE '1.1' END AS version,
       starts_with(url, 'http://') AND ends_with(url, 'page=2&ref=x') AS allowed,
       TRUE AS request_id_ok
FROM pages""",
        "iso_round_trip": f"""{EV}
SELECT event_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS text,
       epoch_us(occurred_at) // 1000000 AS epoch_s,
       epoch_us(occurred_at) // 1000000 - 7200 AS shifted_epoch_s
FROM ev""",
        "request_counters": f"SELECT * FROM ({_counters()}) WHERE value > 0",
        "latency_histogram": _histogram(),
        "latency_quantiles": f"""{LOG},
ranked AS (
  SELECT service, route, latency_ms, ROW_NUMBER() OVER (PARTITION BY service, route ORDER BY latency_ms) AS r,
         COUNT(*) OVER (PARTITION BY service, route) AS n FROM log
)
SELECT service, route, MAX(n) AS requests, MIN(latency_ms) FILTER (r * 100 >= n * 50) AS p50_ms,
       MIN(latency_ms) FILTER (r * 100 >= n * 95) AS p95_ms, MIN(latency_ms) FILTER (r * 100 >= n * 99) AS p99_ms
FROM ranked GROUP BY 1, 2""",
        "alerts_5xx": f"""{LOG}
SELECT service, {_iso("time_bucket(INTERVAL 5 MINUTE, received_at, TIMESTAMP '1970-01-01')")} AS window_start,
       COUNT(*) AS requests, COUNT(*) FILTER (status_code >= 500) AS errors,
       COUNT(*) FILTER (latency_ms > 750) AS slow,
       COUNT(*) FILTER (status_code >= 500) * 100 > COUNT(*) AS error_alert,
       COUNT(*) FILTER (latency_ms > 750) * 20 > COUNT(*) AS p95_alert
FROM log GROUP BY 1, 2""",
        "service_alerts": f"""{LOG},
rule(service, alert, minutes, per_mille) AS (
  VALUES ('ingest', 'error_rate', 5, 10), ('ingest', 'latency_p95', 10, 50), ('analytics', 'error_rate', 10, 5)
),
counted AS (
  SELECT service, alert, per_mille, minutes, to_timestamp(at_ms // 60000 // minutes * minutes * 60) AT TIME ZONE 'UTC'
           AS window_start, COUNT(*) AS requests,
         COUNT(*) FILTER (CASE alert WHEN 'error_rate' THEN status_code >= 500 ELSE latency_ms > 750 END) AS breaches
  FROM log JOIN rule USING (service) GROUP BY ALL
)
SELECT service, alert, {_iso("window_start")} AS window_start, minutes, requests, breaches,
       breaches * 1000 > requests * per_mille AS firing FROM counted""",
        "refresh_lag": f"""{EV}
SELECT event_name AS table_name,
       epoch_us({_AS_OF}) // 1000000 - CAST(floor(epoch_us(MAX(received_at)) / 1000000) AS BIGINT) AS lag_s,
       epoch_us({_AS_OF}) // 1000000 - CAST(floor(epoch_us(MAX(received_at)) / 1000000) AS BIGINT) > 900
         AS lag_alert
FROM ev GROUP BY 1""",
        "rate_pressure_key": _pressure(
            "api_key_id", f"{LOG}, keyed AS (SELECT api_key_id, at_ms FROM log)", 3, 2
        ),
        "rate_pressure_ip": _pressure(
            "ip_prefix",
            f"WITH keyed AS (SELECT {IP_PREFIX} AS ip_prefix, epoch_ms(l_shipdate) +"
            f" {data.LOG['offset_ms']} AS at_ms FROM lineitem)",
            2,
            1,
        ),
        "timestamp_window": f"""{LOG}
SELECT COALESCE(time_reason, 'ok') AS reason, COUNT(*) AS requests
FROM log GROUP BY 1""",
        "replay_flags": f"""
WITH RECURSIVE {LOG.strip().removeprefix("WITH")},
eligible AS (SELECT * FROM log WHERE time_reason IS NULL),
instants AS (
  SELECT api_key_id, nonce, at_ms, MIN(request_id) AS first_id FROM eligible GROUP BY 1, 2, 3
),
islands AS (
  SELECT *, SUM(CASE WHEN gap IS NULL OR gap >= 300000 THEN 1 ELSE 0 END)
              OVER (PARTITION BY api_key_id, nonce ORDER BY at_ms) AS island
  FROM (SELECT *, at_ms - LAG(at_ms) OVER (PARTITION BY api_key_id, nonce ORDER BY at_ms) AS gap
        FROM instants)
),
opened AS (
  SELECT api_key_id, nonce, island, MIN(at_ms) AS at_ms FROM islands GROUP BY 1, 2, 3
  UNION ALL
  SELECT o.api_key_id, o.nonce, o.island, MIN(i.at_ms)
  FROM opened o JOIN islands i USING (api_key_id, nonce, island)
  WHERE i.at_ms >= o.at_ms + 300000 GROUP BY 1, 2, 3
),
accepted AS (SELECT first_id FROM opened JOIN instants USING (api_key_id, nonce, at_ms))
SELECT request_id, time_reason IS NULL AND request_id NOT IN (SELECT first_id FROM accepted) AS is_replay
FROM log""",
        "signature_audit": f"""{LOG},
stamped AS (SELECT *, epoch_us(received_at) // 1000000 + skew_s AS signed FROM log)
SELECT request_id, COALESCE({alpha_hmac} = CASE api_key_id {key_case} END, FALSE) AS signature_ok,
       CAST(44 AS INT) AS digits
FROM stamped""",
        "request_outcome": f"""{LOG},
coded AS (
  SELECT request_id, CASE
    WHEN error_code = 'rate_limited_ip' THEN error_code
    WHEN latency_ms % 53 = 0 THEN 'bad_request'
    WHEN latency_ms % 59 = 0 THEN 'payload_too_large'
    WHEN api_key_id = 'key-4' THEN 'unauthorized'
    WHEN time_reason IS NOT NULL THEN time_reason
    WHEN error_code = 'signature_invalid' THEN error_code
    WHEN latency_ms % 31 = 0 THEN 'replay_detected'
    WHEN error_code = 'rate_limited_key' THEN error_code
    WHEN error_code = 'validation_failed' THEN error_code END AS error_code
  FROM log
)
SELECT request_id, error_code, CASE
    WHEN error_code IN ('rate_limited_ip', 'rate_limited_key') THEN 429
    WHEN error_code IN ('bad_request', 'validation_failed') THEN 400
    WHEN error_code = 'payload_too_large' THEN 413
    WHEN error_code = 'replay_detected' THEN 409
    WHEN error_code IS NULL THEN 202 ELSE 401 END AS status_code
FROM coded""",
        "request_audit": f"""{_audited()}
SELECT request_id, error_code, CASE
    WHEN error_code IN ('rate_limited_ip', 'rate_limited_key') THEN 429
    WHEN error_code IN ('bad_request', 'validation_failed', 'unsupported_schema_version') THEN 400
    WHEN error_code = 'payload_too_large' THEN 413
    WHEN error_code = 'replay_detected' THEN 409
    WHEN error_code IS NULL THEN 202 ELSE 401 END AS status_code
FROM coded""",
        "gated_ingest": f"""{_audited()},
stored AS (
  SELECT uuid, ANY_VALUE(wire_game) AS game_id FROM checked JOIN coded USING (batch_id) WHERE error_code IS NULL GROUP BY 1
)
SELECT 'requests' AS source, COALESCE(error_code, 'accepted') AS item, COUNT(*) AS n FROM coded GROUP BY 1, 2
UNION ALL SELECT 'events', game_id, COUNT(*) FROM stored GROUP BY 1, 2""",
        "dataset_checks": _dataset_checks(),
        "bucket_checks": f"""{sessions16},
pop AS ({POPULARITY} SELECT * FROM popularity),
coh AS ({RETENTION} SELECT * FROM cohorts),
flags AS (
  SELECT suppressed FROM sessions WHERE session_count > 0 UNION ALL SELECT suppressed FROM pop
),
found AS (
  SELECT 'suppressed_buckets' AS "check", COUNT(*) FILTER (suppressed) AS value, 2 AS least FROM flags
  UNION ALL SELECT 'visible_buckets', COUNT(*) FILTER (NOT suppressed), 5 FROM flags
  UNION ALL SELECT 'cohorts_below_10', COUNT(*) FILTER (d7_retained < 10), 1 FROM coh
)
SELECT "check", value, value >= least AS ok FROM found""",
        "counts_by_game": f"""{EV}
SELECT game_id, COUNT(*) AS event_count,
       COUNT(*) FILTER (event_name IN ('quest_started', 'level_end')) AS custom_count
FROM ev GROUP BY 1""",
        "bad_numbers": f"""{EV}
SELECT game_id, COUNT(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0) AS missing,
       COUNT(*) FILTER (event_id % 7 = 0) AS not_numeric
FROM ev WHERE event_name = 'session_end' AND consent_analytics GROUP BY 1""",
        "suppressed_share": f"""{POPULARITY}
SELECT game_id, COUNT(*) AS points, COUNT(*) FILTER (suppressed) AS hidden,
       COUNT(*) FILTER (suppressed) * 2 > COUNT(*) AS empty_state
FROM popularity GROUP BY 1""",
        "ingest_job": STORED,
        "ingest_rejects": f"""{WIRE}
SELECT code, COUNT(*) AS requests FROM judged WHERE code <> 'accepted' GROUP BY 1
UNION ALL SELECT 'unreadable', COUNT(*) FROM judged WHERE code = 'bad_request' HAVING COUNT(*) > 0
UNION ALL SELECT 'reported', COUNT(*) + COUNT(*) FILTER (code = 'bad_request')
FROM judged WHERE code <> 'accepted'""",
        "stream_ingest": STORED,
        "stream_sessions_daily": f"""{EV}
SELECT day AS metric_date, game_id, COUNT(*) AS session_count,
       COUNT(DISTINCT player_id_hash) AS active_players,
       CAST({MEAN} AS BIGINT) AS avg_session_length_s
FROM ev WHERE event_name = 'session_end' AND consent_analytics GROUP BY 1, 2""",
        "idle_sessions": f"""{EV},
gaps AS (
  SELECT *, LAG(occurred_at) OVER (PARTITION BY player_id_hash ORDER BY occurred_at) AS before FROM ev
),
numbered AS (
  SELECT *, SUM(CASE WHEN before IS NULL OR epoch_us(occurred_at) - epoch_us(before) >= 1800000000
                     THEN 1 ELSE 0 END)
            OVER (PARTITION BY player_id_hash ORDER BY occurred_at ROWS UNBOUNDED PRECEDING) AS n
  FROM gaps
)
SELECT player_id_hash, COUNT(*) AS event_count, {_iso("MIN(occurred_at)")} AS started_at,
       {_iso("MAX(occurred_at)")} AS ended_at
FROM numbered GROUP BY player_id_hash, n""",
        "read_results": f"""{EV},
pop AS ({POPULARITY} SELECT * FROM popularity),
coh AS ({RETENTION} SELECT * FROM cohorts),
custom AS (
  SELECT * FROM ev WHERE event_name IN ('level_end', 'quest_started') AND consent_analytics
),
newest AS (
  SELECT * FROM custom WHERE event_name = 'quest_started' AND game_id = 'alpha'
  ORDER BY occurred_at DESC, event_id LIMIT 10
),
found(metric, game_id, points, updated) AS (
  SELECT 'summary', 'all', 1, {_AS_OF}
  UNION ALL SELECT 'sessions', 'all', 30, TIMESTAMP '2024-01-01 01:00:00'
  UNION ALL SELECT 'popularity', 'beta', COUNT(DISTINCT CASE WHEN NOT suppressed THEN character_id END)
      + MAX(CASE WHEN suppressed THEN 1 ELSE 0 END),
    MIN(metric_date) + INTERVAL 1 HOUR FROM pop WHERE game_id = 'beta' AND {last7}
  UNION ALL SELECT 'retention', 'all', COUNT(DISTINCT date_trunc('week', cohort_date)),
    MIN(cohort_date) + INTERVAL 1 HOUR FROM coh WHERE cohort_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-30'
  UNION ALL SELECT 'custom_names', 'all', COUNT(DISTINCT event_name), MAX(received_at) FROM custom
    WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'
  UNION ALL SELECT 'custom_counts', 'alpha', 14, MAX(received_at) FROM custom
    WHERE event_name = 'level_end' AND game_id = 'alpha' AND day BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'
  UNION ALL SELECT 'custom_recent', 'alpha', COUNT(*), MAX(received_at) FROM newest
)
SELECT metric, game_id, CAST(points AS BIGINT) AS points, {_iso("updated")} AS last_updated
FROM found WHERE points > 0""",
        "recent_stored": f"""{EV}
SELECT CAST(event_id AS VARCHAR) AS event_id, game_id, {_iso("occurred_at")} AS occurred_at FROM (
  SELECT * FROM ev WHERE event_name = 'level_end' AND consent_analytics
  ORDER BY epoch_us(occurred_at) DESC, CAST(event_id AS VARCHAR) LIMIT 100)""",
        "offline_events": f"""{WIRE_EVENT}
SELECT uuid || CASE WHEN nl_id <> '' THEN chr(10) ELSE '' END AS event_id,
       strlen({data.WIRE_ENVELOPE}) + strlen({data.WIRE_SENT}) + 1 AS bytes
FROM sized""",
        "seed_append": f"""{EV}
SELECT game_id, 'demo_seed' AS ingest_source, COUNT(*) AS events, COUNT(*) AS on_time,
       (SELECT COUNT(*) FROM ev) AS first_added, CAST(0 AS BIGINT) AS then_added FROM ev GROUP BY 1""",
        "reset_tables": f"""{RETENTION}
SELECT 'before' AS state, (SELECT COUNT(*) FROM ev) AS events, (SELECT COUNT(*) FROM cohorts) AS cohorts
UNION ALL SELECT 'after', 0, 0""",
        "prune_job": f"""{EV}
SELECT day AS event_date, COUNT(*) AS events FROM ev WHERE day >= DATE '2024-01-16' GROUP BY 1""",
        "refresh_incremental": f"""{sessions16},
pop AS ({POPULARITY} SELECT * FROM popularity),
summed AS ({SUMMARY} SELECT * FROM summary),
coh AS ({RETENTION} SELECT * FROM cohorts)
SELECT 'sessions' AS source, game_id, metric_date AS day, '' AS item, session_count AS a, active_players AS b,
       avg_session_length_s AS c FROM sessions
UNION ALL SELECT 'picks', game_id, metric_date, character_id, pick_count, NULL, NULL FROM pop
UNION ALL SELECT 'summary', game_id, NULL, '', active_players_24h, matches_today, avg_session_length_s_24h
FROM summed
UNION ALL SELECT 'cohorts', game_id, cohort_date, '', cohort_size, d1_retained, d7_retained FROM coh""",
        "refresh_all_job": f"""{RETENTION}
SELECT 'sessions' AS source, game_id, COUNT(*) AS figure FROM ev
WHERE event_name = 'session_end' AND consent_analytics GROUP BY 2
UNION ALL SELECT 'picks', game_id, COUNT(*) FROM ev
WHERE event_name = 'character_selected' AND consent_analytics GROUP BY 2
UNION ALL SELECT 'matches', game_id, COUNT(*) FROM ev
WHERE event_name = 'match_end' AND consent_analytics AND day = DATE '2024-01-30' GROUP BY 2
UNION ALL SELECT 'cohorts', game_id, CAST(SUM(cohort_size) AS BIGINT) FROM cohorts GROUP BY 2""",
    }
    # A stream that has ended has the rows of the batch operator.
    for stream, batch in (
        ("stream_sessions", "sessionize"),
        ("stream_replay", "replay_flags"),
        ("stream_orphans", "orphan_matches"),
        ("stream_alerts", "service_alerts"),
    ):
        found[stream] = found[batch]
    found["counts_stored"] = found["custom_counts"]
    found["prune_then_refresh"] = found["refresh_incremental"]
    found["purge_job"] = f"""{EV},
kept AS (SELECT * FROM ev WHERE substr(player_id_hash, 1, 1) NOT IN ('0', '7', 'c')),
stored AS (SELECT game_id, COUNT(*) AS events, COUNT(DISTINCT player_id_hash) AS players FROM kept GROUP BY 1),
ends AS (
  SELECT game_id, COUNT(*) AS sessions, COUNT(DISTINCT (day, player_id_hash)) AS player_days
  FROM kept WHERE event_name = 'session_end' AND consent_analytics GROUP BY 1
),
starts AS (
  SELECT game_id, COUNT(DISTINCT player_id_hash) AS cohort_players
  FROM kept WHERE event_name = 'session_start' AND consent_analytics GROUP BY 1
)
SELECT game_id, events, players, sessions, player_days, cohort_players,
       (SELECT COUNT(*) FROM ev) - (SELECT COUNT(*) FROM kept) AS removed, CAST(0 AS BIGINT) AS again
FROM stored JOIN ends USING (game_id) JOIN starts USING (game_id)"""
    return found
