"""Domains of the query parameters. A value outside its domain is an error, never clipped."""

from __future__ import annotations

import re

from eventlens import fixed_values as fv


def one_of(name: str, value, allowed):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, got {value!r}")
    return value


def within(name: str, value: int, bounds: tuple[int, int]) -> int:
    low, high = bounds
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}, got {value!r}")
    return value


def game(value: str, games: tuple[str, ...]) -> str:
    return one_of("game", value, {*games, "all"})


def visibility(value: str) -> str:
    return one_of("visibility", value, {"public", "private"})


def custom_name(value: str) -> str:
    valid = (
        isinstance(value, str)
        and re.fullmatch(fv.SNAKE_CASE, value)
        and len(value) <= fv.EVENT_NAME_MAX
        and value not in fv.CORE_EVENT_NAMES
    )
    if not valid:
        raise ValueError(f"not a custom event name: {value!r}")
    return value
