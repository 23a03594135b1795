"""Scalar functions, all built from JVM-side Columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from eventlens import fixed_values as fv
from eventlens.functions.text import exact_pattern, matches

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_TAIL_V4 = rf":{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_HEX_GROUP = "[0-9a-fA-F]{1,4}"


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(day: Column) -> Column:
    """Monday of the week of ``day``."""
    return F.to_date(F.date_trunc("week", day))


def ratio4(numerator: Column, denominator: Column) -> Column:
    """Ratio rounded half-up to four places in integer arithmetic; 0 for an empty denominator."""
    n, d = numerator.cast("bigint"), denominator.cast("bigint")
    scaled = F.call_function("div", n * 20000 + d, d * 2)
    return F.when(d == 0, F.lit(0.0)).otherwise(scaled / F.lit(10000.0))


def count_text(props_json: Column, key: str) -> Column:
    """Value of a numeric property as an exact decimal, or null when it is not a number."""
    text = F.get_json_object(props_json, f"$.{key}")
    return text.try_cast("decimal(20,6)")


def iso_utc(ts: Column) -> Column:
    """Instant as ISO-8601 text without the fraction of a second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Instant of ISO-8601 text that ends in Z or an offset, else null."""
    return F.when(matches(text, fv.ISO_DATETIME), F.try_to_timestamp(text))


def is_core_name(name: Column) -> Column:
    return name.isin(*fv.CORE_EVENT_NAMES)


def is_custom_name(name: Column) -> Column:
    """True for a well-formed name that is no core name."""
    well_formed = matches(name, fv.SNAKE_CASE) & (F.length(name) <= fv.EVENT_NAME_MAX)
    return F.coalesce(well_formed & ~is_core_name(name), F.lit(False))


def event_schema_version(name: Column) -> Column:
    return F.when(is_core_name(name), fv.CORE_SCHEMA_VERSION).otherwise(fv.CUSTOM_SCHEMA_VERSION)


def platform_of(os_name: Column) -> Column:
    low = F.lower(os_name)
    return (
        F.when(low.contains("mac"), "mac").when(low.contains("linux"), "linux").otherwise("pc")
    )


def player_hash(game: Column, device: Column, seed: Column) -> Column:
    """Pseudonymous player id; the device stands in for an empty seed."""
    own = F.when(F.coalesce(seed, F.lit("")) == "", device).otherwise(seed)
    return F.sha2(F.concat_ws("::", game, device, own), 256)


def _colons(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))


def _is_ipv6(text: Column) -> Column:
    """A valid IPv6 literal, also with a dotted tail or a zone."""
    bare = F.when(text.contains("%"), F.regexp_replace(text, exact_pattern("%[0-9a-zA-Z.:-]+$"), "")).otherwise(text)
    flat = F.when(bare.contains("."), F.regexp_replace(bare, exact_pattern(_TAIL_V4), ":0:0")).otherwise(bare)
    run = f"{_HEX_GROUP}(:{_HEX_GROUP})*"

    def is_address(text: Column) -> Column:
        full = matches(text, f"^({_HEX_GROUP}:){{7}}{_HEX_GROUP}$")
        # The double colon stands for at least one group, which bounds the number of colons.
        at_edge = text.startswith("::") | text.endswith("::")
        short = matches(text, f"^({run})?::({run})?$") & (_colons(text) <= F.when(at_edge, 8).otherwise(7))
        return full | short

    # Bound once: written out for every use, the code of a row grows too large to be compiled.
    return F.exists(F.array(flat), is_address)


def ip_prefix(ip: Column) -> Column:
    """IPv4 /24 or IPv6 /48 prefix of an address, else ``unknown``."""
    plain = F.when(ip.startswith("::ffff:"), F.substr(ip, F.lit(8))).otherwise(ip)
    v4 = F.concat(F.substring_index(plain, ".", 3), F.lit(".0/24"))

    # The double colon is written out as zeros, as many as groups are missing.
    head = F.substring_index(plain, "::", 1)
    tail = F.substr(plain, F.length(head) + 3)
    in_head = F.when(head == "", 0).otherwise(_colons(head) + 1)
    in_tail = F.when(tail == "", 0).otherwise(_colons(tail) + 1)
    zeros = F.repeat(F.lit("0:"), 8 - in_head - in_tail)
    lead = F.when(head == "", "").otherwise(F.concat(head, F.lit(":")))
    groups = F.concat(lead, zeros, tail)

    def short(group: Column) -> Column:
        digits = F.ltrim(group, F.lit("0"))
        return F.when(digits == "", "0").otherwise(F.lower(digits))

    first = F.transform(F.slice(F.split(groups, ":"), 1, 3), short)
    v6 = F.concat(F.array_join(first, ":"), F.lit("::/48"))
    return F.when(matches(plain, _IPV4), v4).when(_is_ipv6(plain), v6).otherwise("unknown")


def user_agent_label(agent: Column) -> Column:
    filled = F.when(F.coalesce(agent, F.lit("")) == "", "unknown").otherwise(agent)
    # The limit counts UTF-16 units. Half of a pair that is cut through is shown as U+FFFD.
    most = fv.USER_AGENT_MAX
    units = F.encode(filled, "UTF-16BE")
    last = F.conv(F.hex(F.substring(units, 2 * most - 1, 2)), 16, 10).cast("int")
    split = last.between(0xD800, 0xDBFF)
    whole = F.decode(F.substring(units, 1, 2 * most), "UTF-16BE")
    halved = F.concat(F.decode(F.substring(units, 1, 2 * most - 2), "UTF-16BE"), F.lit("\ufffd"))
    plain = F.octet_length(units) == 2 * F.char_length(filled)
    return F.when(plain, F.substring(filled, 1, most)).otherwise(
        F.when(F.coalesce(split, F.lit(False)), halved).otherwise(whole)
    )


def request_id_or_new(request_id: Column) -> Column:
    """The given id when it is well formed, else a new uuid."""
    return F.when(matches(request_id, fv.REQUEST_ID), request_id).otherwise(F.uuid())


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def request_outcome_label(error_code: Column, route: Column, status: Column) -> Column:
    done = F.when((route == "/events") & (status == 202), "accepted").otherwise("ok")
    return F.when(F.coalesce(error_code, F.lit("")) != "", error_code).otherwise(done)


def wildcard_match(value: Column, pattern: str) -> Column:
    """Match against one allow-list entry that may hold a single ``*``."""
    if "*" not in pattern:
        return value == pattern
    prefix, suffix = pattern.split("*")[:2]
    return value.startswith(prefix) & value.endswith(suffix)


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key pads of HMAC-SHA256, so that a key row carries no plain secret."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(ipad: Column, opad: Column, message: Column) -> Column:
    """HMAC-SHA256 as hex, from prepared key pads; stays inside code generation."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)
