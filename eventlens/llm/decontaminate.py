"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton knows every run of words of every item. A document's words are streamed through it;
the state says how long the match that ends at a word is, and which windows of items end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import cut, free_name

WINDOW = 10
#: Words of items in one automaton (about 60 MB in a Python worker for each 100,000 words).
BLOCK_WORDS = 200_000
#: Automata that one pass holds at once; more items take more passes.
BLOCKS_AT_ONCE = 4
MAX_COVERAGE = 0.5

#: Fixed value: bytes of words; A-Z are lower-cased first, all bytes from 0x80 up belong to words.
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        self.ending: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, codes in coded:
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.edges[state][c]
                if n >= window:
                    state = self._holding(state, window)
                    self.ending.setdefault(state, set()).add(item)
            if len(codes) < window:
                self.short.setdefault(self._holding(state, len(codes)), []).append((len(codes), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.at_window, self.near_short = [0] * len(self.link), [0] * len(self.link)
        for s in order:  # links lead to shorter states, which are done already
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.near_short[s] = s if s in self.short else self.near_short[up]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly the word run of ``p`` followed by ``c``, split off if it is longer."""
        q = self.edges[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.edges[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.edges[p]:
            self.edges[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _holding(self, state: int, length: int) -> int:
        """The state on the way up from ``state`` that holds the suffix of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of windows that occur (start, end), and the items they belong to."""
        if len(words) < self.shortest or not self.vocabulary:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        # Only runs of known words that are long enough for a window can hold one.
        gaps = np.flatnonzero(codes < 0)
        edges = np.concatenate(([-1], gaps, [len(words)]))
        long = np.flatnonzero(np.diff(edges) > self.shortest)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for k in long.tolist():
            first = int(edges[k]) + 1
            self._scan_run(codes[first : int(edges[k + 1])].tolist(), first, spans, found)
        return spans, found

    def _scan_run(self, codes: list[int], first: int, spans: list, found: set[str]) -> None:
        edges, link, length, window = self.edges, self.link, self.length, self.window
        state = matched = 0
        for end, c in enumerate(codes, first + 1):
            while state and c not in edges[state]:
                state = link[state]
                matched = length[state]
            state = edges[state].get(c, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                spans.append((end - window, end))
                found |= self.ending.get(self.at_window[state], set())
            at = self.near_short[state]
            while at:
                for n, item in self.short[at]:
                    if n <= matched:
                        spans.append((end - n, end))
                        found.add(item)
                at = self.near_short[link[at]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these ranges of words and what stands between their words."""
    at = [m.span() for m in _WORD_BYTES.finditer(text.lower())]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def _word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[0-9a-zA-Z\\x{80}-\\x{10FFFF}]+"), F.lit(0)))


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of the items, each of about ``block_words`` words; one at a time on the driver."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        _word_count(text).alias("n"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
    )
    total = sized.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    for k in range(count):
        rows = sized.where(F.pmod("h", F.lit(count)) == k).select("id", "text").collect()
        yield Automaton([(r["id"], words_of(bytes(r["text"]) if r["text"] is not None else None)) for r in rows], window)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of ``n_words``, ``spans`` (hit ranges
    of words as start, end, start, end ...), ``n_hit``, ``items`` (ids as strings) and ``clean``,
    the text without the hit ranges.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Null and empty texts and items have no words; items that share an id count once, a
    null id is listed as ``null``. Rows are judged one by one, so equal rows are treated alike; an
    empty table on either side gives an empty result or no hits.
    """
    context = docs.sparkSession.sparkContext
    name = free_name(docs.columns, "hits")
    out = docs.withColumn(
        name,
        F.lit(None).cast("struct<n_words:bigint,spans:array<int>,n_hit:bigint,items:array<string>,clean:binary>"),
    )
    schema = out.schema
    at = docs.columns.index(text_col)

    def scanner(shared):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in it:
                rows = []
                for text, known in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist()):
                    raw = text.as_py()
                    raw = raw.encode() if isinstance(raw, str) else raw
                    words = words_of(raw)
                    spans, found = automaton.scan(words)
                    if known:
                        old = known["spans"]
                        spans, found = [*spans, *zip(old[::2], old[1::2])], found | set(known["items"])
                    spans = merged(spans)
                    rows.append({
                        "n_words": len(words), "spans": [x for s in spans for x in s],
                        "n_hit": sum(b - a for a, b in spans), "items": sorted(found),
                        "clean": without_words(raw, spans) if spans else raw,
                    })
                kind = batch.schema.field(batch.num_columns - 1).type
                columns = [*batch.columns[:-1], pa.array(rows, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return batches

    for k, automaton in enumerate(_blocks(items, item_id, item_text, window, block_words), 1):
        out = out.mapInArrow(scanner(context.broadcast(automaton)), schema)
        if k % BLOCKS_AT_ONCE == 0:
            out = cut(out)
    return out, name


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    max_coverage: float = MAX_COVERAGE,
    **options,
) -> DataFrame:
    """Cut hit word ranges out of the texts; drop documents of which more than ``max_coverage`` is hit.

    Columns are those of ``docs``. Texts without hits, null and empty ones included, stay as they are.
    """
    found, hits = find_contamination(docs, items, text_col, **options)
    hit = F.col(hits)
    text = F.when(hit["n_hit"] > 0, hit["clean"].cast("string")).otherwise(F.col(text_col))
    return found.where(hit["n_hit"] <= max_coverage * hit["n_words"]).select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    )
