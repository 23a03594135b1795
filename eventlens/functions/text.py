"""Pattern matching with the meaning that the event contract gives to its patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: what counts as white space in the contract's patterns, Unicode spaces included.
CONTRACT_SPACE = (
    "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)


def exact_pattern(pattern: str) -> str:
    """The pattern for the JVM: ``$`` is the very end of the text, not also before a last newline,
    and white space is that of the contract."""
    if pattern.endswith("$"):
        pattern = pattern[:-1] + r"\z"
    for written, meant in (
        (r"[^\s@]", f"[^{CONTRACT_SPACE}@]"),
        (r"\s", f"[{CONTRACT_SPACE}]"),
        (r"\S", f"[^{CONTRACT_SPACE}]"),
    ):
        pattern = pattern.replace(written, meant)
    return pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(exact_pattern(pattern))
