import math
import random

import pytest

from eventlens.llm import urls


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(rule), rule, says) for rule, says in urls.RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0]))
        and path.startswith("/" + rule.split("/", 1)[1])
    ]
    _, rule, says = max(fits, default=(0, None, None))
    return host, path, rule, says


ODD = [
    None, "", "no scheme", "http://", "HTTP://Ex.ORG/Es/x?y", "http://a.example.org/es/1", "http://example.org",
    "http://example.org/en/12#x", "http://notexample.org/es/", "x://y://z.com/fr/1", "http://com/de/", "http://a.com?/fr/",
    "http://é.com/fr/ü", "http://a.b\nc.org/x\ny",
]


def pages(spark, rows):
    full = [(i, u, "<p>", "h", "v") for i, u in enumerate(rows)]
    return spark.createDataFrame(full, "page_id long, url string, html string, host string, verdict string")


def random_urls(seed, n):
    rng = random.Random(seed)
    good, bad = ["the", "news", "blog", "wiki"], ["win", "pills", "casino", "xxx"]
    out = []
    for _ in range(n):
        is_good = rng.random() < 0.6
        name = "".join(rng.choice(good if is_good else bad) for _ in range(2))
        zone = rng.choice([".org/x/", ".com/fr/"]) if is_good else ".com/de/"
        zone = ".net/" if rng.random() < 0.3 else zone
        out.append(f"http://{name}{zone}{rng.randrange(1000)}")
    return out


def test_rules_and_parts_against_a_plain_fold(spark):
    rows = [*ODD, *random_urls(1, 200)]
    got = urls.judge(pages(spark, rows)).collect()
    for r in got:
        host, path, rule, says = plain_rule(r.url)
        assert (r[-5], r[-4], r[-3]) == (host, path, rule), r
        assert says is None or r[-2] == says
        assert r[-2] in ("allow", "block")
    assert len(got) == len(rows)


def test_the_ratio_judges_the_rest(spark):
    got = urls.judge(pages(spark, random_urls(2, 1500))).where("rule IS NULL").collect()
    right = sum((r[-2] == "allow") == any(w in r.url for w in ("the", "news", "blog", "wiki")) for r in got)
    assert len(got) > 300 and right >= 0.95 * len(got)


def plain_scores(labelled, rows):
    """Scores from dictionaries of contexts and of the bytes that follow them."""
    counts = {True: {}, False: {}}

    def places(url):
        data = b"\0" * urls.ORDER + url.encode() + b"\n"
        return [(data[i - urls.ORDER : i], data[i]) for i in range(urls.ORDER, len(data))]

    for url, accepted in labelled:
        for context, byte in places(url):
            for k in range(urls.ORDER + 1):
                own = counts[accepted].setdefault(context[urls.ORDER - k :], {})
                own[byte] = own.get(byte, 0) + 1

    def likelihood(url, kind):
        total = 0.0
        for context, byte in places(url):
            p = 1 / 256
            for k in range(urls.ORDER + 1):
                own = counts[kind].get(context[urls.ORDER - k :], {})
                p = (own.get(byte, 0) + urls.SMOOTHING * p) / (sum(own.values()) + urls.SMOOTHING)
            total += math.log(p)
        return total / len(places(url))

    return {url: likelihood(url, True) - likelihood(url, False) for url in rows}


@pytest.mark.parametrize("times", [1, 100])
def test_scores_equal_exact_dictionaries(spark, times, monkeypatch):
    """Also with a hundred times as many URLs, in several groups."""
    monkeypatch.setattr(urls, "GROUP_URLS", 700)
    rng = random.Random(3)
    labelled = [(u, "pills" not in u and "win" not in u) for u in random_urls(3, 40 * times)]
    rows = sorted({*random_urls(9, 60), "ü", "x" * 3000, *(u for u, _ in rng.sample(labelled, 30))})
    counts = urls.count(spark.createDataFrame(labelled, "url string, accepted boolean").repartition(5))
    got = {r.url: r.score for r in urls.score_urls(spark.createDataFrame([(u,) for u in rows], "url string"), counts).collect()}
    expected = plain_scores(labelled, rows)
    assert set(got) == set(expected)
    assert all(abs(got[u] - expected[u]) < 1e-9 for u in rows)


def test_calibration_is_the_best_threshold(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0.6, 0.4), True) for _ in range(300)] + [(rng.gauss(-0.5, 0.4), False) for _ in range(100)]
    t = urls.calibrate(spark.createDataFrame(rows, "score double, accepted boolean"))
    error = lambda x: sum(a and s < x for s, a in rows) / 300 + sum(not a and s >= x for s, a in rows) / 100
    assert error(t) <= min(error(k / 100) for k in range(-100, 100)) + 0.02


def test_empty_and_one_sided_tables(spark):
    assert urls.judge(pages(spark, [])).count() == 0
    got = urls.judge(pages(spark, ["http://a.org/x", "http://b.net/y", None])).collect()
    assert [r.verdict for r in got] == ["v"] * 3 and len(got[0]) == 10
    assert got[0][-2] == "allow"
    assert urls.calibrate(spark.createDataFrame([(1.0, True)], "score double, accepted boolean")) == pytest.approx(0.0)
