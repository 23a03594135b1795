import random
import re

import pytest

from eventlens.llm import decontaminate as d
from tests.llm.conftest import ODD

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, "ONE two three, four five six seven eight nine ten"),
    (4, "a b a b a b a b a b a b a b"),
    (5, ""),
    (6, None),
    (7, "item"),
    (None, "null's own id words"),
]


def plain(text, items, window):
    """Hit word places and items, by comparing every window with every place."""
    fold = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        own = fold(body)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def rows():
    rng = random.Random(8)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve a b short item".split()
    out = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(80)]
    for i, (_, body) in enumerate(ITEMS):
        out.append((300 + i, f"Before it, {body} - after; {body}"))
    return out + [r for r in ODD if len(r[1] or "") < 10_000]


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 7])
def test_against_brute_force(frame, spark, block_words):
    """With blocks of seven words the items need several automata, and several passes."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(rows())
    found, name = d.find_contamination(docs, items, block_words=block_words)
    got = [(r.doc_id, r[name].n_words, r[name].n_hit, r[name]["items"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain(t, ITEMS, 10)) for i, t in rows()), key=repr)
    assert name == "_hits"


def test_cleaned_texts_have_no_hits_left(frame, spark):
    items = spark.createDataFrame([ITEMS[0], ITEMS[3]], "item_id long, text string")
    body = "Own words of the text stand here and there, " * 3
    docs = frame([(1, f"{body}{ITEMS[0][1]}! {body}"), (2, ITEMS[0][1]), (3, body), (4, None)])
    got = {r.doc_id: r.text for r in d.decontaminate(docs, items).collect()}
    assert got == {1: f"{body}! {body}", 3: body, 4: None}
    assert d.decontaminate(frame([]), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, none).count() == 4


def test_longest_matches_of_the_automaton():
    rng = random.Random(1)
    items = [(str(k), [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(1, 25))]) for k in range(12)]
    automaton = d.Automaton(items, 6)
    for _ in range(60):
        words = [rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(60)]
        spans, found = automaton.scan(words)
        places, names = set(), set()
        for item, own in items:
            n = min(6, len(own))
            for i in range(len(own) - n + 1):
                for j in range(61 - n):
                    if words[j : j + n] == own[i : i + n]:
                        places |= set(range(j, j + n))
                        names.add(item)
        assert {p for a, b in spans for p in range(a, b)} == places and found == names
