import json

import pytest
from pyspark.sql import functions as F

from eventlens import Settings
from eventlens.functions.validation import checked_event
from eventlens.plans import ingest
from eventlens.sources import read_requests
from tests.factories import ENVELOPE, PROPERTIES, rows, utc, wire

GAMES = ("alpha", "beta")


def reasons(spark, events):
    """Broken rules per event, for a list of events or JSON texts."""
    texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    checked = checked_event(F.parse_json("text"), GAMES)
    return [r for _, r in sorted(rows(df.select("n", checked["reasons"])))]


def test_factories_are_valid(spark):
    assert reasons(spark, [wire(name) for name in PROPERTIES]) == [[]] * len(PROPERTIES)


def test_core_properties(spark):
    cases = [
        (wire("session_start", props={"launch_reason": "startup"}), "properties.launch_reason"),
        (wire("session_start", props={"timezone_offset_min": 841}), "properties.timezone_offset_min"),
        (wire("session_end", props={"duration_s": "12"}), "properties.duration_s"),
        (wire("session_end", props={"duration_s": 1.5}), "properties.duration_s"),
        (wire("session_end", drop=("xp_earned",)), "properties.xp_earned"),
        (wire("match_start", props={"match_id": "m"}), "properties.match_id"),
        (wire("match_start", props={"team_size": 6}), "properties.team_size"),
        (wire("match_end", props={"character_id": "x" * 33}), "properties.character_id"),
        (wire("match_end", props={"score": None}), "properties.score"),
        (wire("character_selected", props={"perk_ids": list("abcdef")}), "properties.perk_ids"),
        (wire("character_selected", props={"perk_ids": [1]}), "properties.perk_ids"),
        (wire("character_selected", props={"perk_ids": "a"}), "properties.perk_ids"),
        (wire("character_selected", props={"loadout_id": None}), "properties.loadout_id"),
        (wire("character_selected", props={"is_random": 1}), "properties.is_random"),
    ]
    assert reasons(spark, [e for e, _ in cases]) == [[r] for _, r in cases]
    fine = [
        wire("character_selected", props={"perk_ids": [], "loadout_id": "l"}),
        wire("session_end", props={"unknown": {"deep": [1]}}),
        json.dumps(wire("session_end")).replace("86400", "86400.0"),
        json.dumps(wire("session_end")).replace("86400", "8.64e4"),
        wire("session_start", schema_version="2.0"),
    ]
    assert reasons(spark, fine) == [[]] * len(fine)


def test_envelope(spark):
    cases = [
        (wire("level_end", event_id="x"), "event_id"),
        (wire("level_end", player_id_hash="C4A1" * 16), "player_id_hash"),
        (wire("level_end", occurred_at="2026-02-28T23:59:59"), "occurred_at"),
        (wire("level_end", occurred_at="2025-13-20T19:05:31Z"), "occurred_at"),
        (wire("level_end", game_id="gamma"), "game_id"),
        (wire("level_end", game_version="1.2"), "game_version"),
        (wire("level_end", build_id=""), "build_id"),
        (wire("level_end", build_id=12), "build_id"),
        (wire("level_end", platform="ps5"), "platform"),
        (wire("level_end", locale="x"), "locale"),
        (wire("level_end", locale=None), "locale"),
        (wire("level_end", consent_analytics="true"), "consent_analytics"),
        (wire("level_end", drop=("session_id",)), "session_id"),
        (wire("level_end", schema_version="1.0"), "schema_version"),
        (wire("Level", schema_version="1.1"), "event_name"),
        (wire("a" * 49), "event_name"),
        (wire("level_end\n"), "event_name"),
        *[(wire("level_end", **{f: ENVELOPE[f] + "\n"}), f) for f in (
            "event_id", "occurred_at", "session_id", "player_id_hash", "game_id", "game_version", "platform",
        )],
        (wire("session_end", schema_version="1.0\n"), "schema_version"),
    ]
    assert reasons(spark, [e for e, _ in cases]) == [[r] for _, r in cases]
    fine = [
        wire("level_end", locale="pt-BR"),
        wire("level_end", occurred_at="2026-02-28T23:59:59.123+02:00"),
    ]
    assert reasons(spark, fine) == [[], []]
    assert "event_name" in reasons(spark, ["5"])[0]


def test_custom_property_guardrails(spark):
    values = [
        {"nested": {"level": 3}},
        {"nullable": None},
        {"nested_array": [["a"]]},
        {"level_id": "player@example.com"},
        {"level_id": "Bearer abcdef123456"},
        {"level_id": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjMifQ.signature"},
        {"level_id": "x" * 129},
        {"level_id": "bearer\u00a0abcdef"},
        {"level_id": "BEARER\u3000\ufeffabcdef"},
        {"tags": ["ok", "player@example.com"]},
        {"level_id": "😀" * 65},
    ]
    assert reasons(spark, [wire("level_end", props=p) for p in values]) == [["properties.value"]] * len(values)
    keys = (
        "invalidKey account_id api_key auth_token chat_text device_id email email_address"
        " error_message player_id player_id_hash player_name session_id user_external_id"
    ).split() + ["email\n", "fine_key\n"]
    assert reasons(spark, [wire("level_end", props={k: "v"}) for k in keys]) == [["properties.key"]] * len(keys)
    many = wire("level_end", props={f"key_{i}": i for i in range(26)})
    assert reasons(spark, [many]) == [["properties.count"]]
    huge = json.dumps(wire("level_end", props={"n": 1})).replace('"n": 1', '"n": 1e400')
    assert reasons(spark, [huge]) == [["properties.value"]]
    listed = json.dumps(wire("level_end")).replace('{"level_id": "swamp_7", "stars": 0}', "[1]")
    assert "properties" in reasons(spark, [listed])[0]


def test_custom_properties_that_are_fine(spark):
    gameplay = (
        "build_id character_id item_id level_id loadout_id map_id match_id mode_id quest_id"
    ).split()
    fine = [
        wire("level_end", props={key: "v" for key in gameplay}),
        wire("level_end", props={"tags": ["a", 1, True], "empty": [], "ratio": 0.5}),
        wire("level_end", props={"level_id": "x" * 128}),
        wire("level_end", props={"level_id": "😀" * 64}),
    ]
    assert reasons(spark, fine) == [[]] * len(fine)


def test_byte_caps(spark):
    big = wire("level_end", props={"tags": ["x" * 120] * 14})
    assert reasons(spark, [big]) == [["event.bytes", "properties.bytes"]]
    # Keys that are not stored do not count.
    assert reasons(spark, [wire("session_end", props={"blob": "x" * 3000})]) == [[]]


def request(spark, bodies, key="k-alpha"):
    data = [(f"b{i}", key, utc("2025-09-20T19:06:00"), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        data, "batch_id string, api_key_id string, received_at timestamp, body string"
    )


def credentials(spark):
    return spark.createDataFrame(
        [("k-alpha", "alpha", True), ("k-beta", "beta", True), ("k-off", "alpha", False)],
        "api_key_id string, key_game string, enabled boolean",
    )


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def body(*events):
    return json.dumps({"events": list(events)})


@pytest.mark.parametrize(
    "text, key, code",
    [
        (body(wire("level_end")), "k-alpha", None),
        (body(wire("level_end")), "k-off", "unauthorized"),
        (body(wire("level_end")), "k-none", "unauthorized"),
        (body(wire("level_end")), "k-beta", "unauthorized"),
        ('{"events": [', "k-alpha", "bad_request"),
        ("5", "k-alpha", "validation_failed"),
        (body(), "k-alpha", "validation_failed"),
        (body(*[wire("session_start", event_id=uid(i)) for i in range(11)]), "k-alpha", "validation_failed"),
        (body(*[wire("session_start", event_id=uid(i)) for i in range(10)]), "k-alpha", None),
        (body(wire("level_end"), wire("level_end", props={"email": "x"})), "k-alpha", "validation_failed"),
        (body(wire("level_end", schema_version="2.0", event_id=5)), "k-alpha", "unsupported_schema_version"),
        (body(wire("session_end", schema_version="01.3")), "k-alpha", None),
        (body(wire("session_end", schema_version="2.0\n")), "k-alpha", "validation_failed"),
        (body(wire("level_end")) + " junk", "k-alpha", "bad_request"),
        (body(wire("level_end")) + "] junk", "k-alpha", "bad_request"),
        (body(wire("level_end")) + "} {}", "k-alpha", "bad_request"),
        (body(wire("level_end")) + ', "x"]', "k-alpha", "bad_request"),
        (body(wire("level_end")) + " \n\t ", "k-alpha", None),
        ("", "k-alpha", "bad_request"),
        (None, "k-alpha", "bad_request"),
        ('{"events": [{"event_id": 1}], ' + body(wire("level_end"))[1:], "k-alpha", None),
        (body(wire("level_end"))[:-1] + ', "events": []}', "k-alpha", "validation_failed"),
    ],
)
def test_request_codes(spark, text, key, code):
    judged = ingest.judge(request(spark, [text], key), credentials(spark), Settings())
    assert rows(judged, "code") == [(code,)]


def test_rejects_name_rules_but_no_values(spark):
    text = body(wire("level_end"), wire("level_end", props={"contact": "secret@example.com"}))
    lines = ingest.event_lines(
        ingest.judge(request(spark, [text]), credentials(spark), Settings())
    )
    refused = ingest.rejects(lines).orderBy("position")
    assert rows(refused) == [
        ("b0", 0, "validation_failed", []),
        ("b0", 1, "validation_failed", ["properties.value"]),
    ]
    assert "secret" not in str(lines.collect())
    assert rows(ingest.batch_counts(lines), "event_count", "custom_count") == [(2, 2)]


def test_only_well_formed_names_count_as_custom(spark):
    text = body(wire("Bad Name"), wire("a" * 49), wire("level_end\n"), wire("level_end"), wire("session_end"))
    lines = ingest.event_lines(ingest.judge(request(spark, [text]), credentials(spark), Settings()))
    assert rows(ingest.batch_counts(lines), "event_count", "custom_count") == [(5, 1)]


def test_a_key_that_stands_twice_is_refused(spark):
    twice = credentials(spark).unionByName(credentials(spark))
    with pytest.raises(ValueError, match="api_key_id"):
        ingest.judge(request(spark, [body(wire("level_end"))]), twice, Settings())


def test_unreadable_lines_are_reported(spark, tmp_path):
    good = json.dumps({"batch_id": "b", "api_key_id": "k-alpha", "received_at": "2026-01-01T00:00:00Z", "body": body(wire("level_end"))})
    (tmp_path / "in.json").write_text("\n".join([good, "no json", '{"batch_id": ', "no json"]))
    landed = read_requests(spark, str(tmp_path / "in.json"))
    where = [str(tmp_path / name) for name in ("raw", "rejects")]
    for _ in range(2):
        report = ingest.ingest(landed, credentials(spark), where[0], Settings(), where[1])
        assert report.rejected_requests == 3
    refused = spark.read.parquet(where[1])
    assert refused.count() == 3 and rows(refused.select("code").distinct()) == [("bad_request",)]
    assert all(r.batch_id.startswith("unreadable-") for r in refused.collect())
