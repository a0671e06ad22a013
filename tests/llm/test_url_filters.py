from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import clashing
from tidemark.llm import url_filters
from tidemark.llm.queries import RULES
from tidemark.llm.url_filters import Reputation, Rule

PAGES = "page_id long, url string"
URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x", "https://example.org/en/12#t",
    "https://x.example.org/en/2", "ftp://org", "http://org/", "http://foo.com/de/", "http://foo.com/fr/a?b",
    "http://com/de/x", "http://notcom/de/", "a://b://c.com/de/", "http://xexample.org/es/", "http://k.com?/de/",
    "http://ÄÖ.com/fr/\nx", "x" * 50_000 + "://h.com/de/" + "y" * 50_000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_hosts_paths_and_rules(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), PAGES), "host", "rule", "bad")
    none = spark.createDataFrame([], "url string, bad boolean")
    out = {r.page_id: r for r in url_filters.judge_urls(pages, none, RULES).collect()}
    assert len(out) == len(URLS) and out[0].bad == "theirs"
    for i, url in enumerate(URLS):
        host, path = split(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (out[i].host, out[i].path) == (host, path)
        assert (out[i].rule, out[i].verdict) == ((best.text, best.verdict) if best else (None, "allow"))


def test_reputation_is_shrunk_and_bounded(spark):
    """A bad host goes, one bad page does not condemn a host, a bad domain warns of new hosts."""
    seen = [("http://bad.one.net/", True)] * 60 + [("http://good.two.net/", False)] * 200
    seen += [("http://rare.two.net/", True)] + [("http://a.spam.io/", True)] * 80 + [("http://b.spam.io/", True)] * 80
    seen += [(f"http://h{i}.two.net/", False) for i in range(50)] + [("http://x.net/", None), (None, True)]
    pages = [(i, u) for i, u in enumerate([*{u for u, _ in seen}, "http://new.spam.io/q", "http://new.two.net/"])]
    out = url_filters.judge_urls(
        spark.createDataFrame(pages, PAGES), spark.createDataFrame(seen, "url string, bad boolean"), ()
    ).collect()
    verdict = {r.url: r.verdict for r in out}
    assert verdict["http://bad.one.net/"] == "block" and verdict["http://a.spam.io/"] == "block"
    assert verdict["http://good.two.net/"] == "allow" and verdict["http://new.two.net/"] == "allow"
    hosts = spark.createDataFrame([(split(u)[0], 1) for _, u in pages if u], "host string, pages long").distinct()
    outcomes = spark.createDataFrame([(split(u)[0], b) for u, b in seen], "host string, bad boolean")
    mean = {r.host: (r.mean, r.lower) for r in url_filters.host_reputation(hosts, outcomes, Reputation()).collect()}
    assert mean["new.spam.io"][0] > mean["rare.two.net"][0] > mean["h1.two.net"][0]
    assert all(low < m for m, low in mean.values())


@pytest.mark.parametrize("host,want", [
    ("a.b.example.com", "example.com"), ("example.com", "example.com"), ("com", "com"), ("", ""),
    ("www.shop.co.uk", "shop.co.uk"), ("co.uk", "co.uk"), ("a.b.de", "b.de"),
])
def test_registered_domain(spark, host, want):
    column = url_filters.registered_domain(F.lit(host), Reputation().second_level)
    assert spark.range(1).select(column.alias("d")).first().d == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    none = spark.createDataFrame([], "url string, bad boolean")
    assert url_filters.judge_urls(pages, none, [Rule("block", "x.y")]).count() == 0
