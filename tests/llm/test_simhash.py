import random
import re

import numpy as np
import pytest
import xxhash

from eventlens.llm import simhash
from eventlens.llm.components import components
from tests.llm.conftest import ODD


def plain_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    """Smallest id reachable per row; ids of None never name a group."""
    label = list(range(len(fps)))
    find = lambda k: k if label[k] == k else find(label[k])
    for i, (_, x) in enumerate(fps):
        for j, (_, y) in enumerate(fps[:i]):
            if (x ^ y).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def corpus():
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(300)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 400]))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0 and len(words) > 5:
            words[rng.randrange(len(words))] = "Changed"
            rows.append((1000 + i, "  ".join(words).upper()))
    return rows + ODD


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_against_brute_force(frame, tile):
    """With tiles of four rows every larger bucket is cut, and cuts meet in pairs."""
    rows = corpus()
    got = simhash.near_duplicates(frame(rows), tile=tile).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = [(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps))]
    assert sorted(((r.id, r.fp.hex(), r.component) for r in got), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(frame([])).count() == 0


def test_block_tables_cover_the_radius():
    tables = simhash.block_tables(64, 3, 5)
    assert len(tables) == 10
    rng = random.Random(1)
    for _ in range(300):
        flipped = set(rng.sample(range(64), 3))
        assert any(not flipped & set(t.tolist()) for t in tables)


def test_tiles_find_what_all_pairs_find():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 1 << 64, (300, 2), dtype=np.uint64, endpoint=False)
    for k in range(150):  # chains of rows a few bits apart
        rows[k + 1] = rows[k] if k % 10 else rows[k + 1]
        rows[k + 1, k % 2] ^= np.uint64(0b1011 << (k % 40))
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(-1) <= 9
    truth = simhash.Forest(len(rows))
    truth.add(*np.nonzero(near))
    whole = simhash.link_tile(rows, None, 9)
    assert (whole.label == truth.label).all()
    a, b = whole.edges()
    assert len(a) == len(rows) - len(set(truth.label.tolist())) and near[a, b].all()
    halves = simhash.link_tile(rows[:100], rows[100:], 9)
    for f in (simhash.link_tile(rows[:100], None, 9), simhash.link_tile(rows[100:], None, 9)):
        halves.add(*(x + (0 if len(f.label) == 100 else 100) for x in f.edges()))
    assert (halves.label == truth.label).all()
    group = np.repeat([0, 1], 150)
    small = simhash._link_small(rows, group, np.array([150, 150]), 9)
    inside = simhash.Forest(len(rows))
    inside.add(*np.nonzero(near & (group[:, None] == group[None])))
    assert (small.label == inside.label).all()


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 70)] + [(200, 201 + i) for i in range(40)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{200 + i: 200 for i in range(41)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(frame):
    base = " ".join(f"w{k}" for k in range(200))
    near = base.replace("w100", "changed")
    far = " ".join(f"v{k}" for k in range(200))
    rows = [(3, base), (4, near), (5, base), (6, far), (6, far), (2, None), (None, ""), (None, far)]
    docs = frame(rows)
    groups = simhash.near_duplicates(docs, width=1, radius=3)
    kept = simhash.keep_one(docs, groups)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, None), (3, base), (6, far)]


def test_stage_against_brute_force(spark, frame):
    """The stage of the pipeline keeps the smallest id of each group of linked fingerprints."""
    import corpus_pipeline

    rng, rows = random.Random(8), []
    for n in [0, 1, 2, 3, 9, 40, 250] * 8:
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        other = list(words)
        if n > 100:
            other[rng.randrange(n)] = "changed"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    rng.shuffle(rows)
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    component = [i for i, _ in rows]
    for _ in rows:
        for x in range(len(rows)):
            component[x] = min(component[y] for y in range(len(rows)) if (prints[x] ^ prints[y]).bit_count() <= 3)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component))
    assert 20 < len(set(component)) < len(rows) - 20
