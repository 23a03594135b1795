"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``, ``NAME=x``,
``name := x``, ``name => x``), carries constants to the names they are assigned to, and scores each
literal by the names that it reaches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import free_name

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Parts of names that say that a value is secret, and their weights.
STRONG = frozenset(
    "password passwd passphrase pwd secret token apikey credential credentials privatekey accesskey secretkey authkey".split()
)
WEAK = frozenset("key auth pin cert salt signature session cookie bearer".split())
#: Values that stand for a value to be filled in.
PLACEHOLDERS = frozenset(
    "true false none null nil undefined changeme example placeholder redacted password secret token string".split()
)
MIN_SCORE = 0.6
#: Weight of a literal that looks random, which is enough beside a weak name.
RANDOM_WEIGHT = 1.2
MIN_RANDOM, MIN_RANDOM_ENTROPY = 12, 3.0

# A name begins where no word goes on, so a long word is tried once.
_PAIR = re.compile(
    r"""(?<![\w.\-])(?P<q>["']?)(?P<name>[A-Za-z_][\w.\-]*)(?P=q)[ \t]*(?::=|=>|[:=])[ \t]*"""
    r"""(?:"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'|(?P<bare>[^\s"'`,;#<>(){}\[\]]+))"""
)
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*\Z")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=~.\-]+\Z")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Whole matches of the fixed patterns, leftmost and without overlap per kind."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """1 for names of secrets, 0.5 for names that often go with them, else 0."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])} | set(parts)
    return 1.0 if joined & STRONG else 0.5 if joined & WEAK else 0.0


def looks_random(value: str) -> bool:
    """Whether a long token changes between lower case, upper case and digits as no words do."""
    if len(value) < MIN_RANDOM or not _TOKEN.match(value):
        return False
    runs = _NAME_PART.findall(value)
    mean = sum(map(len, runs)) / max(1, len(runs))
    kinds = (any(map(str.isdigit, value)), any(map(str.islower, value)), any(map(str.isupper, value)))
    return sum(kinds) > 1 and mean <= (4.0 if kinds[0] else 2.7)


def value_weight(value: str) -> float:
    """How much a literal looks like a secret: 0 for short and placeholder values, else by entropy.

    A literal that looks random weighs more than 1, so that a name of ``WEAK`` is enough.
    """
    plain = value.strip().lower()
    if len(plain) < 6 or plain in PLACEHOLDERS or set(plain) <= {"x", "*", ".", "-"} or value.startswith(("$", "<", "{", "%")):
        return 0.0
    total = len(plain)
    entropy = -sum(n / total * math.log2(n / total) for n in Counter(plain).values())
    if entropy >= MIN_RANDOM_ENTROPY and looks_random(value.strip()):
        return RANDOM_WEIGHT
    return 1.0 if entropy >= 2.5 and " " not in plain else 0.6


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """``start, end, score`` of literals; the score is that of the best name the literal reaches."""
    if "=" not in text and ":" not in text:
        return []
    literals: list[tuple[int, int, str]] = []
    holds: dict[str, list[int]] = defaultdict(list)  # literals that a name was given
    given: dict[str, set[str]] = defaultdict(set)  # names that a name was given to
    weights: dict[str, float] = {}
    for m in _PAIR.finditer(text):
        name, kind = m["name"].rpartition(".")[2], m.lastgroup
        weights.setdefault(name, name_weight(m["name"]))
        value = m[kind]
        if kind == "bare" and _IDENTIFIER.match(value):
            given[value.rpartition(".")[2]].add(name)
        holds[name].append(len(literals))
        literals.append((m.start(kind), m.end(kind), value))
    best = [0.0] * len(literals)
    for name, own in holds.items():
        seen, todo = {name}, [name]
        while todo:  # every name that this one's value is carried to
            for target in given.get(todo.pop(), ()):
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        weight = max(weights.get(n, 0.0) for n in seen)
        for k in own:
            best[k] = max(best[k], weight)
    is_name = {name for name, own in holds.items() if own}
    return [
        (a, b, w * value_weight(v))
        for (a, b, v), w in zip(literals, best)
        if w and not (text[a - 1 : a] not in "\"'" and v.rpartition(".")[2] in is_name)
    ]


def scan(text: str | None, min_score: float = MIN_SCORE) -> list[Span]:
    """Base spans and literals that score enough and lie in no base span; by start, then kind."""
    text = text or ""
    found = base_spans(text)
    base = list(found)
    for a, b, score in literal_spans(text):
        if score >= min_score and not any(s.start <= a and b <= s.end for s in base):
            found.append(Span("literal", a, b))
    return sorted(set(found), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans (kind, start, end in code points, end exclusive), and its name.

    Each row is scanned by itself, so nulls in other columns, equal rows and empty tables are as in
    the input; null and empty texts have no spans.
    """
    name = free_name(docs.columns, "secrets")
    out = docs.withColumn(name, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>"))
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spans = [[s._asdict() for s in scan(t.as_py(), min_score)] for t in batch.column(at)]
            kind = batch.schema.field(batch.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], schema=batch.schema)

    return out.mapInArrow(batches, out.schema), name
