"""Privacy predicates and masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventlens import fixed_values as fv
from eventlens.functions.text import matches

_SUBJECT_SUFFIX = "^({})_(.*_)?({})$".format(
    "|".join(fv.SENSITIVE_SUBJECTS), "|".join(fv.SENSITIVE_SUFFIXES)
)


def small_group(players: Column, k: int) -> Column:
    """True for a group of 1 to k-1 players. An empty group is shown, it reveals nobody."""
    return F.coalesce(players, F.lit(0)).between(1, k - 1)


def mask(hidden: Column, value: Column) -> Column:
    return F.when(~hidden, value)


def is_sensitive_key(key: Column) -> Column:
    """True for a property key that names an identifier, credential, contact or free text."""
    return ~key.isin(*fv.GAMEPLAY_KEYS) & (
        key.isin(*fv.SENSITIVE_KEYS) | matches(key, _SUBJECT_SUFFIX)
    )


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def is_unsafe_string(text: Column) -> Column:
    """True for a string that is too long or looks like an address or a credential."""
    return (
        (utf16_length(text) > fv.CUSTOM_STRING_MAX)
        | matches(text, fv.EMAIL_LIKE)
        | matches(text, fv.JWT_LIKE)
        | matches(text, fv.BEARER_LIKE)
    )
