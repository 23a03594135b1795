import hashlib
import random

from eventlens.llm import lines
from tests.llm.conftest import ODD

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, min_chars, min_docs):
    """Kept text, lines and dropped lines per row, by a plain fold."""
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    rank = lambda i: (i is not None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(fold(line)) >= min_chars:
                holders.setdefault(fold(line), set()).add(rank(i))
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [
            s for s in own
            if not (len(h := holders.get(fold(s), ())) >= min_docs and max(h) != rank(i))
        ]
        out.append((i, text if len(kept) == len(own) else "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    """The report's columns are the last two: the frames here have their own ``n_dropped``."""
    return sorted(((r[0], r[1], r[-2], r[-1]) for r in df.collect()), key=repr)


def test_random_rows_against_a_plain_fold(frame):
    rng = random.Random(5)
    pool = ["Shared line number %d of the pool" % k for k in range(6)] + ["short", "", " Shared line NUMBER 3 of the pool\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, pool[1]), (None, pool[2]), (7, None), (7, pool[3]), (7, pool[3])]
    got = lines.dedupe_lines(frame(rows), min_chars=12, min_docs=4, report=True)
    assert found(got) == plain(rows, 12, 4)


def test_odd_rows_and_clashing_columns(frame, spark):
    docs = frame(ODD)
    got = lines.dedupe_lines(docs, min_chars=3, min_docs=2)
    assert got.columns == docs.columns and got.count() == len(ODD)
    assert found(lines.dedupe_lines(docs, min_chars=3, min_docs=2, report=True)) == plain(ODD, 3, 2)
    assert lines.dedupe_lines(frame([]), report=True).count() == 0


def test_a_line_of_all_documents_stays_in_the_largest(frame):
    line = "The same footer line stands in every document of the site"
    rows = [(i, f"{line}\nown text {i}") for i in range(30)]
    got = {r.doc_id: r.text for r in lines.dedupe_lines(frame(rows)).collect()}
    assert got[29] == f"{line}\nown text 29"
    assert all(got[i] == f"own text {i}" for i in range(29))
    assert hashlib.sha256(got[0].encode()).hexdigest()
