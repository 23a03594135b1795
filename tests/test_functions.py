import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from eventlens import fixed_values as fv
from eventlens import functions as fn
from eventlens.operators import quality, requests
from eventlens.plans.ingest import request_outcomes
from tests.factories import event, frame, rows, utc


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r[1] for r in sorted(rows(df.select("n", function(F.col("v")))))]


@pytest.mark.parametrize(
    "ip, prefix",
    [
        ("192.168.10.42", "192.168.10.0/24"),
        ("::ffff:10.0.0.1", "10.0.0.0/24"),
        ("2001:0db8:85a3::8a2e:0370:7334", "2001:db8:85a3::/48"),
        ("2001:DB8:0:1:2:3:4:5", "2001:db8:0::/48"),
        ("::1", "0:0:0::/48"),
        ("::", "0:0:0::/48"),
        ("fe80::1%eth0", "fe80:0:0::/48"),
        ("64:ff9b::192.0.2.1", "64:ff9b:0::/48"),
        ("1:2:3:4:5:6:7::", "1:2:3::/48"),
        ("1:2:3:4:5:6:7", "unknown"),
        ("1::2::3", "unknown"),
        ("12345::1", "unknown"),
        ("256.1.1.1", "unknown"),
        ("01.1.1.1", "unknown"),
        ("host", "unknown"),
        ("", "unknown"),
        (None, "unknown"),
    ],
)
def test_ip_prefix(spark, ip, prefix):
    assert apply(spark, fn.ip_prefix, [ip]) == [prefix]


def test_labels(spark):
    assert apply(spark, fn.user_agent_label, [None, "", "a" * 150]) == ["unknown", "unknown", "a" * 120]
    assert apply(spark, fn.platform_of, ["macOS", "Linux", "Windows"]) == ["mac", "linux", "pc"]
    assert apply(spark, fn.event_schema_version, ["match_end", "x"]) == ["1.0", "1.1"]
    assert apply(spark, fn.status_class, [202, 429, 500], "int") == ["2xx", "4xx", "5xx"]
    ids = apply(spark, fn.request_id_or_new, ["req-1", "-bad", None, "x" * 65])
    assert ids[0] == "req-1" and len({len(i) for i in ids[1:]}) == 1 and len(set(ids)) == 4
    wildcard = apply(spark, lambda c: fn.wildcard_match(c, "https://*.example.com"), ["https://a.example.com", "http://a"])
    assert wildcard == [True, False]
    assert apply(spark, lambda c: fn.wildcard_match(c, "app"), ["app", "apps"]) == [True, False]


def test_ratio_is_exact_half_up(spark):
    pairs = [(n, d) for d in range(0, 161) for n in range(0, d + 1)]
    df = spark.createDataFrame(pairs, "n int, d int")
    got = {(r.n, r.d): r.r for r in df.select("n", "d", fn.ratio4(F.col("n"), F.col("d")).alias("r")).collect()}
    assert all(got[n, d] == ((20000 * n + d) // (2 * d) / 10000 if d else 0.0) for n, d in pairs)
    assert got[3, 160] == 0.0188 and got[12, 29] == 0.4138


def test_player_hash(spark):
    df = spark.createDataFrame([("g", "dev", ""), ("g", "dev", None), ("g", "dev", "s")], "g string, d string, s string")
    got = [r[0] for r in rows(df.select(fn.player_hash(F.col("g"), F.col("d"), F.col("s"))))]
    by_device = hashlib.sha256(b"g::dev::dev").hexdigest()
    assert got == [by_device, by_device, hashlib.sha256(b"g::dev::s").hexdigest()]


def test_iso_time(spark):
    texts = ["2026-04-05T12:00:00Z", "2026-04-05T14:00:00.9+02:00", "2026-04-05 12:00:00", "nope"]
    back = apply(spark, lambda c: fn.iso_utc(fn.parse_iso(c)), texts)
    assert back == ["2026-04-05T12:00:00Z", "2026-04-05T12:00:00Z", None, None]


def test_week_starts_on_monday(spark):
    got = apply(spark, lambda c: fn.week_start(F.to_date(c)).cast("string"), ["2026-03-16", "2026-03-22"])
    assert got == ["2026-03-16", "2026-03-16"]


def test_every_listed_key_is_judged(spark):
    assert not any(apply(spark, fn.is_sensitive_key, list(fv.GAMEPLAY_KEYS)))
    assert all(apply(spark, fn.is_sensitive_key, list(fv.SENSITIVE_KEYS)))
    pairs = [f"{s}_{x}" for s in fv.SENSITIVE_SUBJECTS for x in fv.SENSITIVE_SUFFIXES]
    longer = [f"{s}_some_{x}" for s in fv.SENSITIVE_SUBJECTS for x in fv.SENSITIVE_SUFFIXES]
    assert all(apply(spark, fn.is_sensitive_key, pairs + longer))
    fine = ["level", "userid", "user", "id", "users_id", "user_idx", "my_user_id"]
    assert not any(apply(spark, fn.is_sensitive_key, fine))


def test_signature_audit(spark):
    secrets = {"a": "test-secret", "long": "s" * 100}
    keys = spark.createDataFrame(
        [(k, *map(bytearray, fn.hmac_pads(s))) for k, s in secrets.items()],
        "api_key_id string, ipad binary, opad binary",
    )
    good = {
        k: base64.b64encode(hmac.new(s.encode(), b"1\nn\n{\"ok\":\"\xc3\xa9\"}", "sha256").digest()).decode()
        for k, s in secrets.items()
    }
    body = '{"ok":"é"}'
    data = [
        ("r1", "a", "1", "n", body, good["a"]),
        ("r2", "long", "1", "n", body, good["long"].rstrip("=")),
        ("r3", "a", "1", "n", body, good["a"].replace("+", "-").replace("/", "_")),
        ("r4", "a", "1", "n", body + " ", good["a"]),
        ("r5", "long", "1", "n", body, good["a"]),
        ("r6", "none", "1", "n", body, good["a"]),
        ("r7", "a", "1", "n", body, "short"),
        ("r8", "a", "1", "n", body, None),
    ]
    df = spark.createDataFrame(
        data, "request_id string, api_key_id string, timestamp string, nonce string, body string, signature string"
    )
    audited = dict(rows(requests.signature_audit(df, keys), "request_id", "signature_ok"))
    assert [audited[f"r{i}"] for i in range(1, 9)] == [True, True, True] + [False] * 5


def test_outcome_order(spark):
    fine = dict(
        ip_limited=False, content_type="application/json; charset=utf-8", payload_bytes=10, key_known=True,
        time_reason=None, signature_ok=True, is_replay=False, key_limited=False, batch_code=None,
    )
    faults = [
        ("batch_code", "validation_failed", "validation_failed", 400),
        ("key_limited", True, "rate_limited_key", 429),
        ("is_replay", True, "replay_detected", 409),
        ("signature_ok", False, "signature_invalid", 401),
        ("time_reason", "timestamp_out_of_window", "timestamp_out_of_window", 401),
        ("key_known", False, "unauthorized", 401),
        ("payload_bytes", 2**20 + 1, "payload_too_large", 413),
        ("content_type", None, "bad_request", 400),
        ("ip_limited", True, "rate_limited_ip", 429),
    ]
    data, expected = [tuple(fine.values())], [(None, 202)]
    for column, value, code, status in faults:
        fine[column] = value
        data.append(tuple(fine.values()))
        expected.append((code, status))
    df = spark.createDataFrame(
        data,
        "ip_limited boolean, content_type string, payload_bytes int, key_known boolean, time_reason string,"
        " signature_ok boolean, is_replay boolean, key_limited boolean, batch_code string",
    )
    assert rows(request_outcomes(df), "error_code", "status_code") == expected


def test_quality_helpers(spark):
    events = frame(
        spark,
        [
            event("match_start", "2026-04-05T10:00:00", "p", match_id="m1"),
            event("match_end", "2026-04-05T10:10:00", "p", match_id="m1"),
            event("match_end", "2026-04-05T09:00:00", "q", match_id="m1"),
            event("match_end", "2026-04-05T10:00:00", "q", match_id="m2"),
        ],
    )
    orphans = quality.orphan_matches(events, F.get_json_object("props_json", "$.match_id"))
    assert orphans.count() == 2
    purged = quality.purge_opted_out(events, spark.createDataFrame([("q",)], "player_id_hash string"))
    assert purged.count() == 2
    assert quality.keep_recent(events, utc("2026-04-06T10:00:00"), 1).count() == 3
    assert quality.leaked_identifiers(events) == ["api_key_id", "player_id_hash", "session_id"]


def test_the_end_of_a_pattern_is_the_end_of_the_text(spark):
    data = [("10.0.0.1\n", "unknown"), ("10.0.0.1", "10.0.0.0/24"), ("::1%eth0\n", "unknown"), ("1::2\n", "unknown")]
    df = spark.createDataFrame(data, "ip string, expected string")
    assert [r[0] for r in df.select(fn.ip_prefix(df.ip)).collect()] == [e for _, e in data]
    one = spark.range(1)
    made = one.select(fn.request_id_or_new(F.lit("abc\n")), fn.request_id_or_new(F.lit("abc"))).first()
    assert len(made[0]) == 36 and made[1] == "abc"


def test_user_agents_are_cut_by_utf16_units(spark):
    face = "\U0001f600"
    data = [
        ("a" * 130, "a" * 120), (face * 61, face * 60), ("a" + face * 61, "a" + face * 59 + "\ufffd"),
        ("a" * 118 + face, "a" * 118 + face), ("a" * 119 + face, "a" * 119 + "\ufffd"), ("", "unknown"), (None, "unknown"),
        ("é" * 121, "é" * 120), (face, face),
    ]
    df = spark.createDataFrame(data, "agent string, expected string")
    assert [r[0] for r in df.select(fn.user_agent_label(df.agent)).collect()] == [e for _, e in data]


def test_prefix_binds_its_parts_once(spark):
    """Written out for every use, the parts make the code of a row too large to be compiled."""
    plan = spark.range(1).select(fn.ip_prefix(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") < 20
