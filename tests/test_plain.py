"""Events that the patterns accept are those that break no rule."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from eventlens.functions import validation
from eventlens.functions.validation import checked_event

GAMES = ("alpha", "beta")
GOOD = {
    "event_id": "00000000-0000-4000-8000-000000000001",
    "event_name": "session_start",
    "schema_version": "1.0",
    "occurred_at": "2024-01-31T10:00:00Z",
    "session_id": "00000000-0000-4000-8000-000000000002",
    "player_id_hash": "ab" * 32,
    "game_id": "alpha",
    "game_version": "0.6.2",
    "build_id": "b-1",
    "platform": "pc",
    "consent_analytics": True,
    "properties": {"launch_reason": "resume", "connection_mode": "online", "timezone_offset_min": -720},
}
CUSTOM = {"event_name": "quest_done", "schema_version": "1.1"}


def _changed(**fields) -> dict:
    return {k: v for k, v in {**GOOD, **fields}.items() if v is not ...}


CASES = [
    _changed(),
    _changed(consent_analytics=False, locale="pt-BR"),
    _changed(locale=""), _changed(locale="-"), _changed(locale="\t"), _changed(locale=5), _changed(locale=None),
    _changed(locale="=x"), _changed(locale="long-locale"), _changed(build_id="é" * 16), _changed(build_id='"' * 16),
    _changed(build_id=7), _changed(build_id="x" * 17), _changed(build_id=...), _changed(event_name=True),
    _changed(schema_version=1.0), _changed(schema_version="1.0\n"), _changed(game_version="0.6.2\nb-1", build_id=...),
    _changed(occurred_at="2024-02-30T10:00:00Z"), _changed(occurred_at="2024-02-29T10:00:00Z"),
    _changed(occurred_at="2023-04-31T10:00:00Z"), _changed(occurred_at="2024-01-31T24:00:00Z"),
    _changed(occurred_at="2024-01-31T10:00:00.5+02:00"), _changed(event_id={"a": 1}), _changed(session_id=None),
    _changed(properties=...), _changed(properties=[]), _changed(properties={}), _changed(game_id="gamma"),
    *[
        _changed(properties={**GOOD["properties"], **p})
        for p in (
            {"timezone_offset_min": 840}, {"timezone_offset_min": 841}, {"timezone_offset_min": -721},
            {"timezone_offset_min": 1.0}, {"timezone_offset_min": 0.5}, {"timezone_offset_min": "1"},
            {"debug": "x" * 1600}, {"launch_reason": None}, {"connection_mode": "on­line"},
        )
    ],
    *[
        _changed(**CUSTOM, properties=p)
        for p in (
            {}, {"tier": 1}, {"tier": 1e300}, {"tier": -0.25, "ok": True}, {"tier": None}, {"tier": {"a": 1}}, {"tier": [1, "a"]},
            {"email": "x"}, {"user_id": 1}, {"session_token": 1}, {"user_own_key": 1}, {"match_id": "m"}, {"badKey": 1},
            {"note": "a@b.co"}, {"note": "eyJa.b.c"}, {"note": "Bearer abcdef"}, {"note": "x" * 128}, {"note": "x" * 129},
            {"note": "a\nb"}, {"k" + "a" * i: i for i in range(1, 26)},
            {"k" + "a" * i: i for i in range(1, 27)}, {"k" + "a" * i: "x" * 120 for i in range(1, 20)},
        )
    ],
    _changed(event_name="quest_done", properties={"tier": 1}),
    *[_changed(**CUSTOM, properties={"note": v}) for v in ("HUGE", "-HUGE", "Infinity", "NaN")],
    *[
        _changed(event_name="match_end", properties={
            "match_id": GOOD["event_id"], "duration_s": 7200, "result": "win", "character_id": v, "score": 0, "damage_dealt": 500000,
        })
        for v in ("HUGE", "warden", "Infinity", "")
    ],
]


def test_patterns_change_no_result(spark, monkeypatch):
    # A number that is too large for a double.
    texts = [re.sub('"(-?)HUGE"', r"\g<1>1e400", json.dumps(case)) for case in CASES]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "i int, text string")

    def results():
        event = checked_event(F.parse_json("text"), GAMES).dropFields("properties")
        return [r.event for r in frame.select("i", event.alias("event")).orderBy("i").collect()]

    found = results()
    # Nothing is plain: every envelope is written and every event is judged rule by rule.
    monkeypatch.setattr(validation, "_plain_envelope", lambda games: "^(?!)$")
    monkeypatch.setattr(validation, "_is_plain", lambda event: F.lit(False))
    assert found == results()
    assert [not r.reasons for r in found][:2] == [True, True]


def test_plain_events_are_not_judged_rule_by_rule(spark, monkeypatch):
    monkeypatch.setattr(validation, "_size_reasons", lambda event: F.array(F.lit("judged")))
    cases = [GOOD, _changed(locale="pt-BR"), _changed(**CUSTOM, properties={"tier": 3, "level_id": "forest_3"}), _changed(platform="x")]
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, text string")
    event = checked_event(F.parse_json("text"), GAMES)
    found = [r.reasons for r in frame.select("i", event["reasons"].alias("reasons")).orderBy("i").collect()]
    assert found == [[], [], [], ["platform", "judged"]]


@pytest.mark.parametrize("high", [0, 5, 10, 99, 720, 840, 7200, 86400])
def test_ranges_of_whole_numbers(high):
    pattern = re.compile(validation._up_to(high))
    assert all(bool(pattern.fullmatch(str(n))) == (n <= high) for n in range(high * 11 + 12))
    assert not pattern.fullmatch("00") and not pattern.fullmatch("")
