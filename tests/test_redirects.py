"""Redirect chains by pointer jumping, against following each address hop by hop."""

import random

import pytest
from pyspark.sql import functions as F

from webgauge.operators import redirects as r
from webgauge.operators.frontier import crawl_frontier

HOPS = "url string, status int, location string"


def walked(hops, limit):
    known = dict((u, (s, t)) for u, s, t in hops)
    out = {}
    for start in known:
        seen, cur, error = [start], start, None
        while True:
            if cur not in known:
                error = r.MISSING
                break
            target = known[cur][1]
            if target is None:
                break
            if len(seen) > limit:
                error = r.TOO_MANY
                break
            again = target in seen
            seen.append(target)
            cur = target
            if again:
                error = r.LOOP
                break
        if error == r.TOO_MANY and target in seen:
            error = r.LOOP
        out[start] = (error, known[cur][0] if error is None else None, len(seen) - 1)
    return out


@pytest.mark.parametrize("limit", [1, 2, 6, 7])
def test_chains_are_those_of_following_each_hop(spark, limit):
    rng = random.Random(limit)
    hops = []
    for i in range(400):
        target = None if rng.random() < 0.2 else f"https://a.example/{rng.choice([i + 1, i + 1, i + 1, rng.randrange(430)])}"
        hops.append((f"https://a.example/{i}", 200 if target is None else 302, target))
    got = {x.url: x for x in r.redirect_chains(spark.createDataFrame(hops, HOPS), limit).collect()}
    expected = walked(hops, limit)
    assert got.keys() == expected.keys()
    for url, (error, status, _) in expected.items():
        assert (got[url].error, got[url].final_status) == (error, status), url
        chain = got[url].chain
        assert len(chain) == got[url].hops <= limit and all(a.location == b.url for a, b in zip(chain, chain[1:]))
        if error is None:
            assert got[url].hops == expected[url][2] and got[url].final_url == (chain[-1].location if chain else url)


def test_many_addresses_of_one_target(spark):
    hops = spark.range(20_000).select(F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit(301).alias("status"), F.lit("https://a.example/login").alias("location"))
    hops = hops.unionByName(spark.createDataFrame([("https://a.example/login", 302, "https://a.example/in"), ("https://a.example/in", 200, None)], HOPS))
    got = r.redirect_chains(hops).groupBy("hops", "final_url", "error").count().collect()
    assert {tuple(x) for x in got} == {(2, "https://a.example/in", None, 20_000), (1, "https://a.example/in", None, 1), (0, "https://a.example/in", None, 1)}


def test_hops_of_answers(spark):
    rows = [
        ("https://a.example/x/y", 301, "../z#f", 1), ("https://a.example/x/y", 404, None, 0), ("https://a.example/b", 304, None, 0), ("https://a.example/c", 302, "", 0), ("https://a.example/d", 200, "/ignored", 0),
        ("https://a.example/e", 307, "//b.example/", 0), (None, 301, "/x", 0),
    ]
    got = {x.url: (x.status, x.location) for x in r.hops_of(spark.createDataFrame(rows, "url string, status int, location string, fetched_at int")).collect()}
    assert got == {
        "https://a.example/x/y": (301, "https://a.example/z#f"), "https://a.example/b": (304, None), "https://a.example/c": (302, None), "https://a.example/d": (200, None), "https://a.example/e": (307, "https://b.example/"),
    }
    assert r.redirect_chains(spark.createDataFrame([], HOPS)).count() == 0


def test_answers_are_followed_to_their_end(spark):
    rows = [("https://a.example/old", 301, "/new", "moved"), ("https://a.example/new", 200, None, "here"), ("https://a.example/l", 302, "/l", "loop"), ("https://a.example/m", 302, "/nowhere", "x")]
    got = {x.requested_url: x for x in r.followed(spark.createDataFrame(rows, "url string, status int, location string, html string")).collect()}
    assert got.keys() == {"https://a.example/old", "https://a.example/new"}
    old = got["https://a.example/old"]
    assert (old.url, old.html, old.status, [c.url for c in old.redirect_chain]) == ("https://a.example/new", "here", 200, ["https://a.example/old"])
    assert got["https://a.example/new"].redirect_chain == []


def test_identities_reach_the_frontier(spark):
    """Two addresses that lead to one page are claimed once, under the address that was met first."""
    hops = [("https://a.example/1", 301, "https://a.example/3"), ("https://a.example/2", 301, "https://a.example/1"), ("https://a.example/3", 200, None), ("https://a.example/", 200, None), ("https://a.example/4", 301, "https://a.example/4")]
    same = r.identities(r.redirect_chains(spark.createDataFrame(hops, HOPS)))
    assert {(x.url, x.identity) for x in same.collect()} == {("https://a.example/1", "https://a.example/3"), ("https://a.example/2", "https://a.example/3")}
    links = spark.createDataFrame([("a.example", "https://a.example/", f"https://a.example/{i}", k) for k, i in enumerate((2, 1, 3, 4))], "site_key string, src string, dst string, pos int")
    seeds = spark.createDataFrame([("a.example", "https://a.example/")], "site_key string, url string")
    got = crawl_frontier(seeds, links, identities=same).orderBy("place").collect()
    assert [x.url for x in got] == ["https://a.example/", "https://a.example/2", "https://a.example/4"]


def test_an_audit_of_captured_messages(spark, tmp_path):
    """Archive bytes to site reports: robots and sitemap by address, a redirect followed and reported."""
    from webgauge.plans.audit import Fetched, audit_sites
    from webgauge.sources.messages import captures_of_messages, read_messages, write_messages

    page = lambda title, more="": f"<!doctype html><html lang=en><head><title>{title}</title></head><body><h1>{title}</h1><p>Words about {title}.</p>{more}".encode()
    site = "https://a.example"
    files = [
        ("/", 200, [], page("Home of the panels", '<a href="/old">old</a><a href="/hidden">hidden</a>')), ("/old", 301, [("Location", "/new")], b""), ("/new", 200, [], page("The new place")),
        ("/hidden", 200, [], page("Hidden")), ("/robots.txt", 200, [], b"User-agent: *\nDisallow: /hidden\nSitemap: https://a.example/map.xml"), ("/map.xml", 200, [], b"<urlset><url><loc>https://a.example/lone</loc></url></urlset>"),
        ("/lone", 200, [], page("A lone page")),
    ]
    rows = [(site + path, None, status, "", "1.1", [("Content-Type", "text/html"), *lines], bytearray(body)) for path, status, lines, body in files]
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp, status int, status_message string, http_version string, raw_headers array<struct<name:string,value:string>>, body binary")
    write_messages(df, str(tmp_path / "site"))
    messages = read_messages(spark, str(tmp_path / "site"))
    assert captures_of_messages(messages).count() == 7
    report = audit_sites(Fetched.of_messages(messages)).collect()
    assert len(report) == 1 and report[0].site_key == "a.example"
    assert sorted(p.url.removeprefix(site) for p in report[0].pages) == ["/", "/lone", "/new"]
    assert [(x["from"].removeprefix(site), x["to"].removeprefix(site), x["hops"]) for x in report[0].issues.redirects] == [("/old", "/new", 1)]
    crawl = report[0].crawl
    assert (crawl.requested, crawl.crawled, crawl.failed, crawl.discovered, crawl.not_visited, crawl.stopped_early, crawl.sitemap_urls, crawl.robots_found, crawl.sitemap_found) == (25, 3, 0, 3, 0, False, 1, True, True)
