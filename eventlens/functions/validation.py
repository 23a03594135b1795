"""Event validation on VARIANT values, row-local and without Python functions.

Events are handled as an array, the way a request carries them, in passes of ``transform``: open the
JSON object, read its fields by type, then apply the rules. Each pass binds its results, so no field
is extracted twice. The rules of core properties are data: a literal table by event name, of which
one event only visits its own rows.

Most events break no rule. Two patterns made from the same rules recognise them by the text of the
envelope and of the properties; only the others are judged rule by rule. A pattern accepts nothing
that a rule refuses, but need not accept all that the rules allow.

Reasons name a field, never a value: values of refused events must not leak into reports.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from eventlens import fixed_values as fv
from eventlens.functions.privacy import is_sensitive_key, is_unsafe_string, utf16_length
from eventlens.functions.scalars import is_core_name
from eventlens.functions.text import matches

TEXT_FIELDS = (
    "event_id",
    "event_name",
    "schema_version",
    "occurred_at",
    "session_id",
    "player_id_hash",
    "game_id",
    "game_version",
    "build_id",
    "platform",
    "locale",
)
STRICT_FIELDS = (
    "event_id",
    "occurred_at",
    "session_id",
    "player_id_hash",
    "game_id",
    "game_version",
    "platform",
)
ENVELOPE_FIELDS = (*TEXT_FIELDS, "consent_analytics")
# The text of a number or boolean never satisfies a strict pattern or list, so the costly look at the
# JSON type is only needed for the other fields.
_OPENED = "struct<{},properties:map<string,variant>>".format(
    ",".join(f"{name}:{'string' if name in STRICT_FIELDS else 'variant'}" for name in ENVELOPE_FIELDS)
)
_ENVELOPE = "struct<{}>".format(",".join(f"{name}:variant" for name in ENVELOPE_FIELDS))


def _type_name(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("missing"))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _text(value: Column) -> Column:
    """The value of a JSON string; null for anything else."""
    return F.when(_type_name(value) == "STRING", _as(value, "string"))


def _is_number(type_name: Column) -> Column:
    return type_name.isin("BIGINT", "DOUBLE") | type_name.startswith("DECIMAL")


def _no(test: Column) -> Column:
    """Negation that also holds for null, as a missing value never satisfies a rule."""
    return ~F.coalesce(test, F.lit(False))


def _length_between(text: Column, low, high) -> Column:
    return utf16_length(text).between(low, high)


# ---------------------------------------------------------------- reading


def _fields(entry: Column) -> Column:
    """Typed fields of one opened event, beside the ``event`` itself."""
    opened = entry["opened"]
    consent = opened["consent_analytics"]

    def read(name: str) -> Column:
        value = opened[name]
        return (value if name in STRICT_FIELDS else _text(value)).alias(name)

    return F.struct(
        entry["event"].alias("event"),
        *[read(name) for name in TEXT_FIELDS],
        F.when(_type_name(consent) == "BOOLEAN", _as(consent, "boolean")).alias("consent_analytics"),
        opened["locale"].isNotNull().alias("has_locale"),
        opened["properties"].alias("properties"),
    )


# ---------------------------------------------------------------- events without a fault

#: Printable ASCII that JSON writes as it is.
_PLAIN = r"[ !#-\[\]-~]"
_PLAIN_FIELDS = tuple(name for name in TEXT_FIELDS if name != "locale")
# A number beyond all bounds is written as one of these texts.
_NO_NUMBER = r'(?!-?Infinity"|NaN")'
# Every day of the calendar but 29 February, and seconds with at most six places.
_PLAIN_INSTANT = (
    r"[1-9]\d{3}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)"
    r"|02-(?:0[1-9]|1\d|2[0-8]))T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?Z"
)


def _one_of(texts) -> str:
    return "(?:{})".format("|".join(re.escape(t) for t in texts if re.fullmatch(_PLAIN + "+", t)) or "(?!)")


def _plain_envelope(games: tuple[str, ...]) -> str:
    """Pattern of envelopes that keep all rules, written as ``_envelope_text``."""

    def inner(pattern: str) -> str:
        return pattern.removeprefix("^").removesuffix("$")

    def length(low: int, high: int) -> str:
        return f"{_PLAIN}{{{low},{high}}}"

    parts = {
        "event_id": inner(fv.UUID_ANY),
        "event_name": f"(?=.{{1,{fv.EVENT_NAME_MAX}}}\n){inner(fv.SNAKE_CASE)}",
        "schema_version": inner(fv.MAJOR_MINOR),
        "occurred_at": _PLAIN_INSTANT,
        "session_id": inner(fv.UUID_ANY),
        "player_id_hash": inner(fv.HEX_64),
        "game_id": _one_of(games),
        "game_version": inner(fv.SEMVER),
        "build_id": length(*fv.BUILD_ID_LENGTH),
        "platform": _one_of(fv.PLATFORMS),
    }
    locale = f"(?:-|={length(*fv.LOCALE_LENGTH)})"
    return "^{}$".format("\n".join([*[parts[name] for name in _PLAIN_FIELDS], locale]))


def _envelope_text(event: Column) -> Column:
    """The text fields line by line; null if one is missing or no text. A locale follows ``=``, and
    ``-`` stands for none."""
    locale = F.when(event["has_locale"], F.concat(F.lit("="), event["locale"])).otherwise("-")
    lines = [part for name in _PLAIN_FIELDS for part in (event[name], F.lit("\n"))]
    return F.concat(*lines, locale)


def _with_plain(event: Column, games: tuple[str, ...]) -> Column:
    """Add the bytes of ``envelope_plain``, an envelope that keeps all rules; null for any other."""
    consent = event["consent_analytics"]
    sample = {**{name: "" for name in _PLAIN_FIELDS}, "consent_analytics": True}
    rest = len(json.dumps(sample, separators=(",", ":"))) - len(_PLAIN_FIELDS)
    rest = rest + F.when(consent, 0).otherwise(1) + F.when(event["has_locale"], len(',"locale":""') - 1).otherwise(-1)

    def written(text: Column) -> Column:
        plain = consent.isNotNull() & matches(text, _plain_envelope(games))
        return F.when(plain, F.octet_length(text) + rest)

    # A list of one text binds it, so that it is put together once.
    return event.withField("envelope_plain", F.get(F.transform(F.array(_envelope_text(event)), written), F.lit(0)))


def _up_to(high: int) -> str:
    """Pattern of the whole numbers from 0 to ``high``."""
    digits = str(high)
    parts = ["0", digits]
    if len(digits) > 1:
        parts.append(rf"[1-9]\d{{0,{len(digits) - 2}}}")
    for k, digit in enumerate(digits):
        low = 1 if k == 0 else 0
        if int(digit) > low:
            parts.append(rf"{digits[:k]}[{low}-{int(digit) - 1}]\d{{{len(digits) - 1 - k}}}")
    return "(?:{})".format("|".join(parts))


def _plain_value(rule: dict) -> str:
    """Pattern of JSON values that keep a core rule."""
    text = f'"{_NO_NUMBER}{_PLAIN}{{{rule["low"]},{rule["high"]}}}"'
    if rule["kind"] == "int":
        if rule["low"] < 0 <= rule["high"]:
            return f"(?:{_up_to(rule['high'])}|-(?!0){_up_to(-rule['low'])})"
        return {0: "", 1: "(?!0)"}.get(rule["low"], "(?!)") + _up_to(max(rule["high"], 0))
    if rule["kind"] == "enum":
        return f'"{_one_of(rule["allowed"])}"'
    if rule["kind"] == "uuid":
        return '"{}"'.format(fv.UUID_ANY.strip("^$"))
    if rule["kind"] == "bool":
        return "(?:true|false)"
    if rule["kind"] == "text":
        return text
    if rule["kind"] == "text list" and rule["most"] > 0:
        return rf"\[(?:{text}(?:,{text}){{0,{rule['most'] - 1}}})?\]"
    return "(?!)"


def _plain_properties() -> str:
    """Pattern of stored properties that keep all rules, behind the event's name and version."""
    core = []
    for name, rules in fv.CORE_PROPERTIES.items():
        keys = ""
        for key, args in sorted(rules.items()):
            rule = _rule(key, *args)
            keys += f'(?:"{key}":{_plain_value(rule)}(?:,|(?=}})))' + ("?" if rule["optional"] else "")
        core.append(rf"{name} {fv.MAJOR_MINOR.strip('^$')}\{{{keys}\}}")
    subjects, suffixes = "|".join(fv.SENSITIVE_SUBJECTS), "|".join(fv.SENSITIVE_SUFFIXES)
    key = (
        rf'"(?!(?:{"|".join(fv.SENSITIVE_KEYS)})")(?!(?:{subjects})_(?:[a-z0-9_]*_)?(?:{suffixes})")'
        rf'{fv.SNAKE_CASE.strip("^$")}"'
    )
    # No text with an @, or that begins as a token does.
    text = rf'"{_NO_NUMBER}(?!eyJ|[bB][eE][aA][rR][eE][rR])[ !#-?A-\[\]-~]{{0,{fv.CUSTOM_STRING_MAX}}}"'
    pair = rf"{key}:(?:true|false|-?\d{{1,15}}(?:\.\d{{1,15}})?|{text})"
    custom = (
        rf"(?!(?:{'|'.join(fv.CORE_EVENT_NAMES)}) ){fv.SNAKE_CASE.strip('^$')} "
        rf"{re.escape(fv.CUSTOM_SCHEMA_VERSION)}\{{(?:{pair}(?:,{pair}){{0,{fv.CUSTOM_MAX_KEYS - 1}}})?\}}"
    )
    return "^(?:{})$".format("|".join([*core, custom]))


def _event_bytes(event: Column) -> Column:
    # `{...}` + `,"properties":` + properties, of which the closing brace is already counted.
    return event["envelope_bytes"] + len(',"properties":') + F.octet_length(event["props_json"])


def _is_plain(event: Column) -> Column:
    """True for an event that surely breaks no rule."""
    described = F.concat(event["event_name"], F.lit(" "), event["schema_version"], event["props_json"])
    return (
        event["envelope_plain"].isNotNull()
        & (_event_bytes(event) <= fv.EVENT_MAX_BYTES)
        & (F.octet_length(event["props_json"]) <= fv.PROPERTIES_MAX_BYTES)
        & matches(described, _plain_properties())
    )


def _known(properties: Column, keys) -> Column:
    return F.map_filter(properties, lambda key, _: key.isin(*keys))


def _with_stored(event: Column) -> Column:
    """Add the properties as stored: core events keep their known keys, custom events keep all."""
    kept = event["properties"]
    for name, rules in fv.CORE_PROPERTIES.items():
        kept = F.when(event["event_name"] == name, _known(event["properties"], rules)).otherwise(kept)
    opened = _as(event["event"], _ENVELOPE)
    written = F.to_json(F.struct(*[opened[name].alias(name) for name in ENVELOPE_FIELDS]))
    envelope = F.coalesce(event["envelope_plain"], F.octet_length(written))
    return event.withField("envelope_bytes", envelope).withField("props_json", F.to_json(kept))


# ---------------------------------------------------------------- rules


_RULE = (
    "struct<key:string,kind:string,optional:boolean,low:bigint,high:bigint,most:int,"
    "allowed:array<string>>"
)


def _rule(key: str, kind: str, *args) -> dict:
    numbers = [a for a in args if not isinstance(a, tuple)]
    most = numbers.pop(0) if kind == "optional text list" else 0
    low, high = numbers or (0, 0)
    return {
        "key": key,
        "kind": kind.removeprefix("optional "),
        "optional": kind.startswith("optional"),
        "low": low,
        "high": high,
        "most": most,
        "allowed": list(args[0]) if kind == "enum" else [],
    }


def _rule_table() -> Column:
    """Core property rules by event name. The text is a literal, so it is parsed once, in planning."""
    table = {
        name: [_rule(key, *rule) for key, rule in rules.items()]
        for name, rules in fv.CORE_PROPERTIES.items()
    }
    return F.from_json(F.lit(json.dumps(table)), f"map<string,array<{_RULE}>>")


def _property_ok(entry: Column) -> Column:
    rule, value, kind, text = entry["rule"], entry["value"], entry["type"], entry["text"]
    number = F.when(_is_number(kind), _as(value, "double"))
    items = F.when(kind.startswith("ARRAY"), _as(value, "array<variant>"))
    texts_ok = F.forall(items, lambda v: _length_between(_text(v), rule["low"], rule["high"]))
    asked = rule["kind"]
    ok = (
        F.when(asked == "int", (number == F.floor(number)) & number.between(rule["low"], rule["high"]))
        .when(asked == "enum", F.array_contains(rule["allowed"], text))
        .when(asked == "uuid", matches(text, fv.UUID_ANY))
        .when(asked == "bool", kind == "BOOLEAN")
        .when(asked == "text", _length_between(text, rule["low"], rule["high"]))
        .when(asked == "text list", (F.size(items) <= rule["most"]) & texts_ok)
    )
    return (rule["optional"] & value.isNull()) | F.coalesce(ok, F.lit(False))


def _core_reasons(event: Column) -> Column:
    rules = F.try_element_at(_rule_table(), event["event_name"])
    found = F.transform(
        rules,
        lambda r: F.struct(r.alias("rule"), F.try_element_at(event["properties"], r["key"]).alias("value")),
    )
    typed = F.transform(
        found,
        lambda e: F.struct(
            e["rule"].alias("rule"),
            e["value"].alias("value"),
            _type_name(e["value"]).alias("type"),
            _text(e["value"]).alias("text"),
        ),
    )
    broken = F.filter(typed, lambda e: ~_property_ok(e))
    names = F.transform(broken, lambda e: F.concat(F.lit("properties."), e["rule"]["key"]))
    return F.coalesce(names, F.array().cast("array<string>"))


def _custom_value_ok(value: Column) -> Column:
    def primitive_ok(v: Column) -> Column:
        kind = _type_name(v)
        number = _as(v, "double")
        return (
            F.when(kind == "STRING", ~is_unsafe_string(_as(v, "string")))
            .when(kind == "BOOLEAN", F.lit(True))
            .when(_is_number(kind), ~F.isnan(number) & (F.abs(number) != float("inf")))
            .otherwise(F.lit(False))
        )

    is_list = _type_name(value).startswith("ARRAY")
    return F.when(is_list, F.forall(_as(value, "array<variant>"), primitive_ok)).otherwise(
        primitive_ok(value)
    )


def _custom_reasons(event: Column) -> Column:
    keys, values = F.map_keys(event["properties"]), F.map_values(event["properties"])
    rules = [
        ("schema_version", event["schema_version"] == fv.CUSTOM_SCHEMA_VERSION),
        ("properties", event["properties"].isNotNull()),
        ("properties.count", F.size(keys) <= fv.CUSTOM_MAX_KEYS),
        ("properties.key", F.forall(keys, lambda k: matches(k, fv.SNAKE_CASE) & ~is_sensitive_key(k))),
        ("properties.value", F.forall(values, _custom_value_ok)),
    ]
    return F.array(*[F.when(_no(ok), name) for name, ok in rules])


def _envelope_reasons(event: Column, games: tuple[str, ...]) -> Column:
    name, occurred = event["event_name"], event["occurred_at"]
    is_time = matches(occurred, fv.ISO_DATETIME) & F.try_to_timestamp(occurred).isNotNull()
    locale = _length_between(event["locale"], *fv.LOCALE_LENGTH)
    rules = [
        ("event_id", matches(event["event_id"], fv.UUID_ANY)),
        ("event_name", matches(name, fv.SNAKE_CASE) & (F.length(name) <= fv.EVENT_NAME_MAX)),
        ("schema_version", matches(event["schema_version"], fv.MAJOR_MINOR)),
        ("occurred_at", is_time),
        ("session_id", matches(event["session_id"], fv.UUID_ANY)),
        ("player_id_hash", matches(event["player_id_hash"], fv.HEX_64)),
        ("game_id", event["game_id"].isin(*games)),
        ("game_version", matches(event["game_version"], fv.SEMVER)),
        ("build_id", _length_between(event["build_id"], *fv.BUILD_ID_LENGTH)),
        ("platform", event["platform"].isin(*fv.PLATFORMS)),
        ("locale", ~event["has_locale"] | F.coalesce(locale, F.lit(False))),
        ("consent_analytics", event["consent_analytics"].isNotNull()),
    ]
    return F.array(*[F.when(_no(ok), field) for field, ok in rules])


def _size_reasons(event: Column) -> Column:
    return F.array(
        F.when(_event_bytes(event) > fv.EVENT_MAX_BYTES, "event.bytes"),
        F.when(F.octet_length(event["props_json"]) > fv.PROPERTIES_MAX_BYTES, "properties.bytes"),
    )


def _reasons(event: Column, games: tuple[str, ...]) -> Column:
    is_core = F.coalesce(is_core_name(event["event_name"]), F.lit(False))
    own = F.when(is_core, _core_reasons(event)).otherwise(_custom_reasons(event))
    every = F.concat(_envelope_reasons(event, games), own, _size_reasons(event))
    none = F.array().cast("array<string>")
    return F.when(_is_plain(event), none).otherwise(F.array_distinct(F.array_compact(every)))


def checked_events(events: Column, games: tuple[str, ...]) -> Column:
    """Typed events with ``reasons``, the names of the broken rules, from an array of VARIANT
    that was parsed from JSON.

    A valid event has no reasons. Fields: the envelope, ``properties`` (map), ``props_json`` (as
    stored), ``event_bytes`` and ``reasons``.
    """
    opened = F.transform(events, lambda e: F.struct(e.alias("event"), _as(e, _OPENED).alias("opened")))
    typed = F.transform(opened, _fields)
    marked = F.transform(typed, lambda e: _with_plain(e, games))
    stored = F.transform(marked, _with_stored)

    def judged(e: Column) -> Column:
        sized = e.withField("event_bytes", _event_bytes(e)).withField("reasons", _reasons(e, games))
        return sized.dropFields("event", "envelope_plain")

    return F.transform(stored, judged)


def checked_event(event: Column, games: tuple[str, ...]) -> Column:
    """``checked_events`` for a single VARIANT event."""
    return F.get(checked_events(F.array(event), games), F.lit(0))
