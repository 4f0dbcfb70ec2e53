"""Robots, sitemaps, site analysis, frontier, vitals, addresses, admission and jobs."""

import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webgauge.constants import VITALS
from webgauge.functions import net, urls
from webgauge.operators import admission, frontier, robots, scoring, site, vitals
from webgauge.sources import captures
from webgauge.streaming.jobs import stream_jobs


def verdict(spark, text, path, agent):
    rules = robots.robots_rules(spark.createDataFrame([("o", text)], "origin string, text string"))
    r = robots.access(rules, spark.createDataFrame([("o", path, agent)], "origin string, path string, agent string")).first()
    return r.allowed, r.rule


def test_robots(spark):
    assert verdict(spark, "User-agent: *\nDisallow: /a\nAllow: /a", "/ab", "X") == (True, "/a")  # allow wins ties
    assert verdict(spark, "User-agent: *\nDisallow: /*.pdf$", "/x.pdf", "X") == (False, "/*.pdf$")
    assert verdict(spark, "User-agent: *\nDisallow: /*.pdf$", "/x.pdf?y", "X") == (True, None)
    assert verdict(spark, "User-agent: a\nUser-agent: b\nDisallow: /", "/x", "B") == (False, "/")  # agents share rules
    assert verdict(spark, "User-agent: googlebot-image\nDisallow: /\nUser-agent: *\nAllow: /", "/x", "Googlebot") == (False, "/")  # prefixes both ways
    assert verdict(spark, "User-agent: bot\nDisallow: /a\nUser-agent: bot\nDisallow: /b", "/b", "bot") == (True, None)  # groups aren't merged
    assert verdict(spark, "Disallow: /\nUser-agent: *\nDisallow:", "/", "x") == (True, None)
    assert verdict(spark, "User-agent: *\n# c\nDisallow: /p # why", "/p1", "x") == (False, "/p")
    assert verdict(spark, "User-agent: x\nSitemap: s\nUser-agent: y\nDisallow: /", "/", "x") == (False, "/")  # a sitemap doesn't end the agents
    assert verdict(spark, "", "/", "x") == (True, None)


def test_crawlers_and_search(spark):
    rules = robots.robots_rules(spark.createDataFrame([("o", "User-agent: GPTBot\nDisallow: /\nUser-agent: *\nDisallow: /q")], "origin string, text string"))
    paths = spark.createDataFrame([("o", "/q"), ("o", "/r")], "origin string, path string")
    got = robots.crawler_access(rules, paths)
    assert got.count() == 32 and {r.agent for r in got.where("path = '/r' and not allowed").collect()} == {"GPTBot"}
    assert {r.path: r.blocking_rule for r in robots.search_blocked(rules, paths).collect()} == {"/q": "/q", "/r": None}


def test_captured_files(spark):
    fetched = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /\nSitemap: x"), ("b", 200, "<!doctype html>x"), ("c", 404, None)], "origin string, status int, text string")
    r = {x.origin: x for x in captures.read_robots(fetched).collect()}
    assert r["a"].found and r["a"].has_sitemap_line and r["a"].blocks_all and r["b"].html_instead and not r["b"].found and not r["c"].found
    index = "<sitemapindex>" + "".join(f"<loc>s{i}</loc>" for i in range(7)) + "</sitemapindex>"
    files = spark.createDataFrame([("top", index), *[(f"s{i}", f"<urlset><loc>u{i}&amp;x</loc><loc> v{i} </loc></urlset>") for i in range(1, 7)]], "url string, xml string")
    got = captures.sitemap_urls(spark.createDataFrame([("o", "top")], "origin string, url string"), files, 7).orderBy("pos").collect()
    assert [r.url for r in got] == ["u1&x", "v1", "u2&x", "v2", "u3&x", "v3", "u4&x"]
    import gzip

    b = spark.createDataFrame([(bytearray(gzip.compress("é".encode("latin-1"))), "gzip", "text/html; charset=latin1"), (bytearray(b"<meta charset=windows-1252>\x80"), None, None), (bytearray(b"xx"), "gzip", "x; charset=no-such")], "body binary, enc string, ct string")
    raw = b.withColumn("body", captures.inflate("body", "enc"))
    assert [r.t for r in raw.select(captures.decode_body(F.col("ct"), F.col("body")).alias("t")).collect()] == ["é", "<meta charset=windows-1252>€", "xx"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.ORG/a/?utm_source=x&ref=1#f", "http://example.org/a?utm_source=x"),
        ("https://example.org", "https://example.org/"),
        ("https://example.org:443/p/?gclid=2", "https://example.org/p"),
        ("mailto:x@y.z", None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == want


def test_url_functions(spark):
    row = spark.range(1).select(
        urls.resolve(F.lit("../c?x#y"), F.lit("https://e.org/a/b/d")).alias("a"), urls.resolve(F.lit("//z.org/q"), F.lit("https://e.org/")).alias("b"), urls.resolve(F.lit("?k=1"), F.lit("https://e.org/p")).alias("c"),
        urls.normalize(F.lit(" example.org/x ")).alias("d"), urls.normalize(F.lit("nodots")).alias("e"), urls.is_authoritative(F.lit("www.sub.nih.gov")).alias("f"), urls.is_authoritative(F.lit("notnih.org")).alias("g"),
        urls.is_social(F.lit("https://m.facebook.com/x")).alias("h"), F.size(urls.dynamic_params(F.array(F.lit("reference"), F.lit("q")))).alias("i"), urls.www_variant(F.lit("https://a.b.org/")).alias("j"),
    ).first()
    assert list(row) == ["https://e.org/a/c?x#y", "https://z.org/q", "https://e.org/p?k=1", "https://example.org/x", None, True, False, True, 1, None]


def test_addresses(spark):
    cases = {
        "8.8.8.8": None, "10.1.2.3": "private", "100.64.0.1": "carrier", "172.32.0.1": None, "198.19.1.1": "benchmark", "203.0.113.9": "documentation", "255.1.1.1": "reserved", "1.2.3": "not a valid", "1.2.3.256": "not a valid",
        "::": "unspecified", "::1": "loopback", "ff02::1": "multicast", "febf::1": "link-local", "fd00::1": "unique-local", "::ffff:10.0.0.1": "IPv4-mapped", "::ffff:8.8.8.8": None, "64:ff9b::127.0.0.1": "NAT64",
        "2002:0a00:0001::": "6to4", "2001:0:1::": "Teredo", "2606:4700::1111": None, "1::2::3": "not a valid", "12345::": "not a valid", "::ffff:1.2.3.999": "not a valid", "1:2:3:4:5:6:7": "not a valid",
    }
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    got = {r.ip: r.why for r in df.select("ip", net.address_reason(F.col("ip")).alias("why")).collect()}
    for ip, want in cases.items():
        assert (got[ip] is None) if want is None else want in got[ip], ip
    row = spark.range(1).select(net.url_refusal(F.lit("https"), F.lit(22), F.array(F.lit(None).cast("string"))).alias("a"), net.url_refusal(F.lit("https"), F.lit(8080), F.array(F.lit(None).cast("string"), F.lit("bad"))).alias("b"), net.url_refusal(F.lit("ftp"), F.lit(None), F.array().cast("array<string>")).alias("c")).first()
    assert list(row) == ["a reserved port", "bad", "only http and https are fetched"]


def test_vitals(spark):
    rows = [("a", m, float(v), [0.7, 0.2, 0.1]) for m, (v, _, _, _, _) in VITALS.items()] + [("b", "lcp", 4000.5, None), ("b", "other", 1.0, None), ("c", "fcp", 9999.0, None)]
    r = vitals.rated(spark.createDataFrame(rows, "target string, metric string, p75 double, density array<double>"))
    assert {x.rating for x in r.where("target = 'a'").collect()} == {"good"}
    assert {(x.metric, x.rating) for x in r.where("target <> 'a'").collect()} == {("lcp", "poor"), ("other", None), ("fcp", "poor")}
    assert {x.target: x.passes for x in vitals.passes(r).collect()} == {"a": True, "b": False, "c": True}
    shown = spark.createDataFrame([("lcp", 2500.0), ("inp", 199.6), ("cls", 0.126), ("cls", None)], "m string, v double").select(vitals.display(F.col("m"), F.col("v")).alias("s"))
    assert [x.s for x in shown.collect()] == ["2.50 s", "200 ms", "0.13", "—"]
    parsed = spark.createDataFrame([('{"record":{"key":{"url":"u"},"metrics":{"largest_contentful_paint":{"histogram":[{"density":0.5}],"percentiles":{"p75":"2500"}}}}}',)], "b string").select(vitals.parse_response(F.col("b")).alias("r")).first().r
    assert parsed.record.metrics["largest_contentful_paint"].percentiles.p75 == "2500"


def test_scores_round_before_weighting(spark):
    rows = [(1, 0, "meta", 0, "a", "critical", k, s, "t", f"do {k % 2}") for k, s in enumerate(["ok", "fail", "warn", "info"])] + [(1, 1, "quality", 0, "b", "nice", 0, "warn", "t", " do 1 "), (1, 6, "external", 0, "c", "low", 0, "fail", "t", "see"), (2, 0, "meta", 0, "a", "low", 0, "info", "t", None)]
    f = spark.createDataFrame(rows, "page_id long, cat_pos int, category string, check_pos int, check string, importance string, find_pos int, status string, text string, todo string")
    c = scoring.category_scores(scoring.check_points(f), "seo", F.col("category") == "external")
    assert {(r.page_id, r.category): r.score for r in c.collect()} == {(1, "meta"): 33, (1, "quality"): 0, (1, "external"): 0, (2, "meta"): None}
    assert {r.page_id: r.score for r in scoring.page_scores(c).collect()} == {1: int(33 * 22 / 46 + 0.5), 2: 0}
    assert {r.page_id: r.errors for r in scoring.page_totals(f).collect()} == {1: 2, 2: 0}
    assert [(r.action, r.check) for r in scoring.todos(f).orderBy("place").collect()] == [("do 1", "a"), ("do 0", "a"), ("see", "c")]


def queue_crawl(seed, links, depth, pages, sitemap=(), identity=None):
    """One worker: links: page -> targets in page order."""
    identity = identity or {}
    queue, seen, audited, out, pending = deque([(seed, 0, "seed")]), {seed}, set(), [], deque(sitemap)
    while len(out) < pages:
        item = queue.popleft() if queue else None
        while item is None and pending:
            url = pending.popleft()
            if url not in seen:
                seen.add(url)
                item = (url, None, "sitemap")
        if item is None:
            break
        final = identity.get(item[0], item[0])
        if final in audited:
            continue
        audited.add(final)
        seen.add(final)
        out.append(item)
        below = 1 if item[1] is None else item[1] + 1
        for v in links.get(item[0], ()) if below <= depth else ():
            if v not in seen:
                seen.add(v)
                queue.append((v, below, "link"))
    return {u: (d, k + 1, s) for k, (u, d, s) in enumerate(out)}


@pytest.mark.parametrize("seed, depth, budget", [(1, 4, 12), (3, 1, 30), (5, 4, 1)])
def test_frontier(spark, seed, depth, budget):
    rng = random.Random(seed)
    edges = [("s", f"p{rng.randrange(25):02}", f"p{rng.randrange(40):02}", k) for k in range(60)]
    rng.shuffle(edges)
    links = {}
    for _, a, b, _ in sorted(edges, key=lambda e: e[3]):
        if a != b:
            links.setdefault(a, []).append(b)
    sitemap = [f"p{rng.randrange(60):02}" for _ in range(12)]
    identity = {f"p{k:02}": f"p{k + 1:02}" for k in range(3, 40, 9)}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    seeds, graph = frame([("s", "p00")], "site_key string, url string"), frame(edges, "site_key string, src string, dst string, pos int")
    for more, ends in (((), identity), (sitemap, identity)) if seed > 1 else ((sitemap, None),):
        got = frontier.crawl_frontier(
            seeds, graph, depth, budget, frame([("s", k, u) for k, u in enumerate(more)], "site_key string, pos int, url string") if more else None,
            frame([("s", u, v) for u, v in ends.items()], "site_key string, url string, identity string") if ends else None,
        ).collect()
        want = queue_crawl("p00", links, depth, budget, list(dict.fromkeys(more)), ends)
        assert {r.url: (r.depth, r.place, r.source) for r in got} == want
    assert frontier.crawl_frontier(seeds.limit(0), graph).count() == 0


def test_crawlable_links(spark):
    robots_file = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /no")], "origin string, text string")
    rows = [(k, "https://a.com/x", u) for k, u in enumerate(["https://a.com/1", "https://www.a.com/2", "https://b.com/3", "https://a.com/4.pdf", "https://a.com/no/5", "https://a.com/yes?no"])]
    links = spark.createDataFrame([("a.com", s, d, k) for k, s, d in rows], "site_key string, src string, dst string, pos int")
    assert sorted(r.pos for r in frontier.crawlable(links, robots.robots_rules(robots_file)).collect()) == [0, 1, 5]


def test_site_groups(spark):
    pages = spark.createDataFrame([("s", "/a", " Same "), ("s", "/b", "same"), ("s", "/c", ""), ("t", "/a", "same")], "site_key string, url string, title string")
    g = site.duplicate_groups(pages, F.col("title")).collect()
    assert [(r.site_key, r.key, r.label, r["count"], r.urls) for r in g] == [("s", "same", "Same", 2, ["/a", "/b"])]
    assert site.dedupe_identity(pages, F.lower(F.trim("title")), [F.col("url")]).count() == 3


def fold(times, quota, window):
    start = count = None
    out = []
    for t in times:
        if start is None or t >= start + window:
            start, count = t, 0
        out.append(count < quota)
        count += count < quota
    return out


def test_admission(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for k in range(5):
        times = sorted(rng.randrange(0, 600) for _ in range(60 if k else 1))
        want[str(k)] = fold(times, 3, 50)
        rows += [(str(k), k * 1000 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "event_id", "ts"])).repartition(3)
    got = admission.admissions(df, 3, 50).toPandas().sort_values(["key", "event_id"])
    assert {k: g.admitted.tolist() for k, g in got.groupby("key")} == want
    assert admission.admissions(df.limit(0)).count() == 0


def test_job_stream(spark, tmp_path):
    t = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    batches = [[("j1", "o", t(0), "running"), ("j2", "o", t(1), "running")], [("j1", "o", t(5), "done"), ("j1", "o", t(6), "error")], [("j3", "o", t(4000), "running")], [("j3", "o", t(8000), "running")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(pd.DataFrame(b, columns=["job_id", "owner", "ts", "status"])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, owner string, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_jobs(stream).writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("jobs").orderBy("updated_at").collect():
        last.setdefault(r.job_id, []).append(r.status)
    assert last["j1"][-1] == "done" and last["j2"][-1] == "error"
