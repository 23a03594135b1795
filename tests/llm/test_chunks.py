import random

from eventlens.llm import chunks
from tests.llm.conftest import ODD


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "ing", "on", "er", "re", "at"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_cuts_resist_insertions():
    rng = random.Random(1)
    text = words(rng, 3000).encode()
    ends = chunks.cuts(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    assert 20 < len(text) / len(ends) < 80
    moved = b"Some inserted words. " + text
    shared = {e + 21 for e in ends} & set(chunks.cuts(moved))
    assert len(shared) > 0.97 * len(ends)
    assert chunks.cuts(b"") == [] and chunks.cuts(b"x") == [1]
    assert all(b - a <= chunks.MAX_CHUNK for a, b in zip([0, *ends], ends))


def test_blocks_give_the_same_cuts(monkeypatch):
    text = words(random.Random(2), 4000).encode()
    whole = chunks.cuts(text)
    monkeypatch.setattr(chunks, "BLOCK", 1000)
    assert chunks.cuts(text) == whole


def plain(rows, min_bytes):
    """Kept texts by a plain count of the passages of distinct rows, in order of id."""

    def of(text):
        data = (text or "").encode()
        ends = chunks.cuts(data)
        for start in [0, *ends[:-1]] if ends else []:
            stop = next((e for e in ends if e - start >= min_bytes), None)
            if stop:
                yield start, stop, data[start:stop]

    first, count = {}, {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for key in order:
        for a, _, d in of(key[2]):
            first.setdefault(d, (key, a))
            count[d] = count.get(d, 0) + 1
    out = []
    for i, t in rows:
        key, data = (i is None, i or 0, t or ""), (t or "").encode()
        gone = sorted({k for a, b, d in of(t) if count[d] > 1 and first[d] != (key, a) for k in range(a, b)})
        kept = bytearray(data)
        for k in gone:
            kept[k] = 0
        text = bytes(kept).replace(b"\0", b"").decode(errors="ignore") if gone else t
        out.append((i, text, len(gone)))
    return sorted(out, key=repr)


def test_what_goes_stands_earlier_as_a_whole(frame):
    """Every removed byte lies in 160 bytes that stand in an earlier text or earlier in the text.

    The check looks at all slices of the texts and knows of no chunks.
    """
    rng = random.Random(11)
    pool = [words(rng, rng.randint(15, 60)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 12) for _ in range(6))) for i in range(24)]
    got = {r.doc_id: r for r in chunks.dedupe_passages(frame(rows), report=True).collect()}
    known, removed = set(), 0
    for i, text in rows:
        for a, b in chunks.united([(k, k + 1) for k in _gaps(text, got[i].text)]):
            covered = set()
            for s in range(a, b - 159):
                part = text[s : s + 160]
                if part in known or text.find(part) < s:
                    covered |= set(range(s, s + 160))
            assert covered == set(range(a, b)) or _shifts(text, a, b, known)
            removed += b - a
        known |= {text[s : s + 160] for s in range(len(text) - 159)}
    assert removed > 2_000


def _gaps(text, kept):
    """Places of the text that are not in the kept text, as a subsequence of whole runs."""
    import difflib

    match = difflib.SequenceMatcher(None, text, kept, autojunk=False)
    inside = set()
    for m in match.get_matching_blocks():
        inside |= set(range(m.a, m.a + m.size))
    return sorted(set(range(len(text))) - inside)


def _shifts(text, a, b, known):
    """The same gap some characters earlier or later, where the text repeats at its ends."""
    for k in range(-60, 61):
        x, y = a + k, b + k
        if 0 <= x and y <= len(text) and text[:x] + text[y:] == text[:a] + text[b:]:
            covered = set()
            for s in range(x, y - 159):
                part = text[s : s + 160]
                if part in known or text.find(part) < s:
                    covered |= set(range(s, s + 160))
            if covered == set(range(x, y)):
                return True
    return False


def test_against_a_plain_count(frame):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = []
    for i in range(100, 160):
        text = words(rng, rng.randint(20, 200))
        if i % 4 == 0:
            text = f"{text}\n{passage} {words(rng, 30)}"
        rows.append((i, text))
    rows += [(170, rows[5][1]), (171, rows[5][1]), *ODD]
    unique_ids = [r for r in rows if rows.count(r) == 1 or r[0] is not None]
    got = chunks.dedupe_passages(frame(unique_ids), report=True).collect()
    # Rows that share an id are ordered by a digest, so only single ids are compared.
    single = [r for r in unique_ids if sum(q[0] == r[0] for q in unique_ids) == 1]
    ids = {r[0] for r in single}
    mine = sorted(((r[0], r[1], r[-2]) for r in got if r[0] in ids), key=repr)
    assert mine == [r for r in plain(unique_ids, chunks.MIN_PASSAGE) if r[0] in ids]
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i][-1] for i in range(100, 160, 4))
    assert sum(passage in (r.text or "") for r in got) == 1
    assert not any(by_id[i][-1] for i in range(101, 160, 4) if i != 105)


def test_odd_rows_and_characters(frame):
    docs = frame(ODD)
    out = chunks.dedupe_passages(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert chunks.dedupe_passages(frame([]), report=True).count() == 0
    accents = "ñandú çà öß éè " * 200
    got = {r.doc_id: r.text for r in chunks.dedupe_passages(frame([(1, accents), (2, "x" + accents)])).collect()}
    assert set(got) == {1, 2} and len(got[2]) < len(accents)


def test_short_passages_are_found():
    """Random passages of 260 to 330 bytes between different surroundings."""
    rng, missed = random.Random(7), 0
    for _ in range(600):
        passage = words(rng, 80)[: rng.randint(260, 330)]
        one, two = (f"{words(rng, 60)} {passage} {words(rng, 60)}".encode() for _ in range(2))
        known = set(chunks.digests(one, chunks.MIN_PASSAGE).tolist())
        missed += not known & set(chunks.digests(two, chunks.MIN_PASSAGE).tolist())
    assert missed <= 12
