"""URL rules against plain Python; the trees on URLs with a learnable pattern."""
import random

import pytest

from churnlens.llm import url_filter as m


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in m.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "http://example.org", "http://EXAMPLE.org/es/x?y#z", "http://notexample.org/es/1",
        "https://a.b.example.org/en/12", "https://example.org/en/2", "ftp://x.com/fr/", "http://com/de/1", "http://x.com?a=/de/",
        "http://x.com#/de/", "http://x.com/de", "http://ÉX.org/é\n/é", "a://b://c.org/d", "http://.org/", "x" * 5000 + "://y.com/de/"]


@pytest.fixture
def pages(spark):
    def make(urls):
        rows = [(i, u, "<html>", 1, 2) for i, u in enumerate(urls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string, host int, label int")
    return make


def test_rules(pages):
    got = {r.row.page_id: r for r in m.url_filter(pages(URLS)).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_the_pattern(pages):
    rnd = random.Random(2)
    urls, bad = [], []
    for i in range(1200):
        spam = rnd.random() < 0.4
        name = "-".join(rnd.choice(["win", "bet", "pill"]) for _ in range(4)) if spam else "".join(rnd.choice("aeioulmn") for _ in range(6))
        tail = f"{rnd.randrange(10 ** 8)}?a={rnd.randrange(99)}&b=1&c=2" if spam else "page"
        kind = rnd.choice(["rule", "free"])
        urls.append(f"http://{name}.com/{'de' if spam else 'fr'}/{tail}" if kind == "rule" else f"http://{name}.net/xx/{tail}")
        bad.append(spam)
    out = {r.row.page_id: r for r in m.url_filter(pages(urls)).collect()}
    free = [i for i in range(len(urls)) if out[i].rule is None]
    right = sum((out[i].verdict == "block") == bad[i] for i in free)
    assert right / len(free) > 0.9
    assert all(0 <= out[i].score <= 1 for i in free) and all(out[i].score is None for i in range(len(urls)) if out[i].rule)


def test_one_verdict_or_none_and_empty(pages):
    only = m.url_filter(pages(["http://a.com/de/1", "http://b.net/"])).collect()
    assert {r.row.page_id: r.verdict for r in only} == {0: "block", 1: "block"}
    assert [r.verdict for r in m.url_filter(pages(["http://b.net/", None])).collect()] == ["allow", "allow"]
    assert m.url_filter(pages(["x"]).where("false")).count() == 0


def test_repeated_rows_are_judged_alike(pages):
    urls = ["http://a.com/de/1", "http://a.com/fr/1"] * 30 + ["http://q.net/en/5"] * 7
    out = m.url_filter(pages(urls)).collect()
    assert len(out) == len(urls) and len({r.verdict for r in out if r.host == "q.net"}) == 1
