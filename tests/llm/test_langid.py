import random

from eventlens.llm import langid
from tests.llm.conftest import ODD

PARTS = {
    "aa": "the and ing tion wh sh of".split(),
    "bb": "der und sch lich keit ung zu".split(),
    "cc": "que ción los mente ado rr la".split(),
}


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3)))
    return [
        (i, " ".join(word(lang) for _ in range(rng.randint(10, 80))), lang, "s")
        for i, lang in enumerate(rng.choices(list(PARTS), [6, 2, 1], k=n))
    ]


def test_held_out_accuracy(frame):
    train, test = texts(1, 300), texts(2, 300)
    found, name = langid.identify(frame(test), frame(train))
    rows = found.collect()
    assert sum(r[name].lang == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r[name].score <= 1 for r in rows)


def test_odd_rows(frame):
    found, name = langid.identify(frame([*ODD, (90, "12 34 !"), (91, None)]), frame(texts(1, 50)))
    rows = found.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert (r[name].lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(frame([]), frame([]))[0].count() == 0
    nothing, name = langid.identify(frame([(1, "text")]), frame([(1, "text", None, "s")]))
    assert nothing.first()[name].lang == "und"


def test_narrow_margins_are_not_accepted(frame):
    same = "same words here " * 20
    found, name = langid.identify(frame([(1, "same words")]), frame([(1, same, "bb", "s"), (2, same, "aa", "s")]))
    assert tuple(found.first()[name]) == ("aa", 0.0, False)


def test_numbers_that_are_no_letters():
    assert [langid.letters(t) for t in ("½", "²", "Ⅳ ①", "a½B ²c")] == ["", "", "", "a b c"]


def test_languages_in_several_passes_give_the_same(frame, monkeypatch):
    """300 languages at once, and the result of passes over few of them."""
    rng = random.Random(4)
    train = [(i, "".join(rng.choice("abcdefghij") for _ in range(300)), f"l{i % 300:03d}", "s") for i in range(300)]
    test = [(i, t[100:180] if i % 2 else "½ 12") for i, t, *_ in train[:40]]
    found, name = langid.identify(frame(test), frame(train))  # two passes
    several = {r.doc_id: tuple(r[name]) for r in found.collect()}
    monkeypatch.setattr(langid, "GROUP", 1000)
    found, name = langid.identify(frame(test), frame(train))
    assert several == {r.doc_id: tuple(r[name]) for r in found.collect()}
    assert all(several[i][0] == (f"l{i:03d}" if i % 2 else "und") for i in range(40))
