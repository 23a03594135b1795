"""The chain of gates against a plain fold over random requests."""

import base64
import hashlib
import hmac
import random
from datetime import timedelta
from pathlib import Path

import pytest

from eventlens import Settings
from eventlens import functions as fn
from eventlens.plans.audit import admit, audit, passed
from eventlens.sources.tables import Scratch, read_events, shared_folder
from tests.factories import rows, utc, wire
from tests.test_validation import body

START = utc("2026-04-05T12:00:00")
SECRETS = {"k-a": "first", "k-off": "second"}
COLUMNS = (
    "request_id string, received_at timestamp, ip string, content_type string, api_key_id string,"
    " timestamp string, nonce string, signature string, body string"
)


def sign(secret, *parts):
    return base64.b64encode(hmac.new(secret.encode(), "\n".join(parts).encode(), hashlib.sha256).digest()).decode()


def random_log(seed, n=260):
    rng = random.Random(seed)
    good, bad = body(wire("level_end")), body(wire("level_end", platform="ps5"))
    out = []
    for i in range(n):
        at = START + timedelta(milliseconds=rng.randrange(0, 240_000, 500))
        key = rng.choice(["k-a"] * 8 + ["k-off", "k-none"])
        stamp = str(int(at.timestamp()) + rng.choice([0] * 9 + [400]))
        nonce = f"00000000-0000-4000-8000-{rng.randrange(120):012d}" + rng.choice([""] * 15 + ["\n"])
        text = rng.choice([good] * 5 + [bad, good + " x"])
        signature = sign(SECRETS.get(key, "none"), stamp, nonce, text if rng.random() < 0.9 else "other")
        kind = rng.choice(["application/json"] * 9 + ["text/plain"])
        out.append((f"r{i:04d}", at, f"10.0.{rng.randrange(3)}.{rng.randrange(9)}", kind, key, stamp, nonce, signature, text))
    return out


def beyond(log, key, limits):
    """Requests over the limits of trailing minutes and ten seconds, the largest ids of an instant."""
    out = set()
    for r in log:
        own = [q for q in log if key(q) == key(r) and q[1] == r[1]]
        over = 0
        for seconds, limit in ((60, limits[0]), (10, max(1, -(-limits[1] * 10 // 60)))):
            recent = [q for q in log if key(q) == key(r) and timedelta(0) <= r[1] - q[1] < timedelta(seconds=seconds)]
            over = max(over, min(len(recent) - limit, len(own)))
        if sorted(q[0] for q in own).index(r[0]) >= len(own) - over:
            out.add(r[0])
    return out


def fold(log, settings):
    codes = {}
    limited = beyond(log, lambda r: r[2].rpartition(".")[0], (settings.ip_per_minute, settings.ip_burst_per_minute))
    opened, fresh = {}, []
    for r in sorted(log, key=lambda r: (r[1], r[0])):
        name, at, _, kind, key, stamp, nonce, signature, text = r
        if name in limited:
            codes[name] = "rate_limited_ip"
        elif kind != "application/json":
            codes[name] = "bad_request"
        elif key != "k-a":
            codes[name] = "unauthorized"
        elif nonce.endswith("\n"):
            codes[name] = "bad_request"
        elif abs(int(at.timestamp()) - int(stamp)) > settings.replay_window_s:
            codes[name] = "timestamp_out_of_window"
        elif signature != sign(SECRETS[key], stamp, nonce, text):
            codes[name] = "signature_invalid"
        elif nonce in opened and at - opened[nonce] < timedelta(seconds=settings.replay_window_s):
            codes[name] = "replay_detected"
        else:
            opened[nonce] = at
            fresh.append(r)
    pressed = beyond(fresh, lambda r: r[4], (settings.key_per_minute, settings.key_burst_per_minute))
    for r in fresh:
        text_code = "validation_failed" if "ps5" in r[8] else "bad_request" if r[8].endswith(" x") else None
        codes[r[0]] = "rate_limited_key" if r[0] in pressed else text_code
    return codes


SETTINGS = Settings(ip_per_minute=20, ip_burst_per_minute=36, key_per_minute=18, key_burst_per_minute=30)


def credentials(spark):
    pads = {k: tuple(map(bytearray, fn.hmac_pads(s))) for k, s in SECRETS.items()}
    return spark.createDataFrame(
        [("k-a", "alpha", True, *pads["k-a"]), ("k-off", "alpha", False, *pads["k-off"])],
        "api_key_id string, key_game string, enabled boolean, ipad binary, opad binary",
    )


def written(spark):
    """Tables of the gates that stand in the shared folder."""
    return {p.name for p in Path(shared_folder(spark)).iterdir() if p.name.split("-")[0] in ("audit", "admit", "replay", "append")}


def test_the_chain_equals_a_fold(spark):
    log, before = random_log(5), written(spark)
    scratch = Scratch(spark, "audit")
    audited = audit(spark.createDataFrame(log, COLUMNS), credentials(spark), SETTINGS, scratch)
    found = dict(rows(audited, "request_id", "error_code"))
    expected = fold(log, SETTINGS)
    assert found == expected and len(set(expected.values())) == 10 - 1
    assert {r[0] for r in rows(passed(audited), "batch_id")} == {k for k, c in expected.items() if c is None}
    assert len(written(spark) - before) == 1  # the outcomes
    scratch.clear()
    assert written(spark) == before


def test_the_log_is_read_once_for_all_gates_but_the_bodies(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(random_log(6, 40), COLUMNS).write.parquet(path)
    plan = audit(spark.read.parquet(path), credentials(spark), SETTINGS)._jdf.queryExecution().optimizedPlan().toString()
    # The result adds the codes to the log; everything before stands in written tables.
    assert plan.count("Relation [") == 2


def test_admitted_requests_are_stored_and_counted(spark, tmp_path):
    log, raw = random_log(7), str(tmp_path / "raw")
    expected, before = fold(log, SETTINGS), written(spark)
    done = admit(spark.createDataFrame(log, COLUMNS), credentials(spark), raw, SETTINGS)
    codes = [c or "accepted" for c in expected.values()]
    assert done.requests == {c: codes.count(c) for c in codes}
    # Every good body holds the same event.
    assert done.added == read_events(spark, raw).count() == 1
    assert admit(spark.createDataFrame(log, COLUMNS), credentials(spark), raw, SETTINGS).added == 0
    assert written(spark) == before


def test_an_audit_that_fails_leaves_no_table(spark, monkeypatch):
    def broken(*_):
        raise RuntimeError("lost")

    before = written(spark)
    monkeypatch.setattr("eventlens.plans.audit.judge", broken)
    with pytest.raises(RuntimeError):
        audit(spark.createDataFrame(random_log(8, 20), COLUMNS), credentials(spark), SETTINGS)
    assert written(spark) == before


def test_an_empty_log(spark, tmp_path):
    log = spark.createDataFrame([], COLUMNS)
    assert audit(log, credentials(spark)).count() == 0
    done = admit(log, credentials(spark), str(tmp_path / "raw"))
    assert (done.added, done.requests) == (0, {})
