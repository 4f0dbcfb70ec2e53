"""A small site audited end to end, counted by hand."""

import json

import pytest
from pyspark.sql import functions as F

from webgauge.plans import audit, report
from webgauge.sources import captures

WORDS = "Plain words about one thing and another, told at some length for whoever reads them. "


def page(title, links=(), words=40, head=""):
    anchors = "".join(f"<p><a href='{u}'>to {u}</a></p>" for u in links)
    return f"<!doctype html><html lang=en><head><title>{title}</title>{head}</head><body><h1>{title}</h1><p>{WORDS * words}</p>{anchors}</body></html>"


PAGES = [
    (1, "https://a.com/", 200, page("Home of all things here", ["/two", "/one", "/gone", "/file.pdf", "/closed/x", "https://www.a.com/three", "https://b.com/"])),
    (2, "https://a.com/one", 200, page("A title that is shared", ["/", "/four"])),
    (3, "https://a.com/two", 404, page("A title that is shared", ["/one"], 2)),
    (4, "https://www.a.com/three", 200, page("Page three of the site", [], 2, "<link rel=icon href='/icon.png'>")),
    (5, "https://a.com/four", 200, page("Page four of the site")),
    (6, "https://a.com/alone", 200, page("Nobody links to this page")),
    (7, "https://a.com/closed/x", 200, page("Kept out by the robots file")),
    (8, "https://b.com/", 200, page("Another site's only page")),
]


@pytest.fixture(scope="module")
def fetched(spark):
    frame = spark.createDataFrame
    pages = frame(PAGES, "page_id long, url string, status int, html string").withColumn("as_of", F.lit("2024-06-01").cast("timestamp"))
    robots = frame([("https://a.com", 200, "User-agent: *\nDisallow: /closed\nSitemap: https://a.com/map.xml\n\nUser-agent: GPTBot\nUser-agent: PerplexityBot\nDisallow: /\n"), ("https://www.a.com", 404, None), ("https://b.com", 200, "<html>no")], "origin string, status int, text string")
    xml = "<urlset>" + "".join(f"<url><loc>https://a.com{p}</loc></url>" for p in ("/", "/alone", "/four", "/closed/x")) + "</urlset>"
    sitemaps = frame([("https://a.com/map.xml", 200, xml), ("https://b.com/sitemap.xml", 404, None)], "url string, status int, xml string")
    llms = frame([("https://a.com", 200, "# a"), ("https://b.com", 404, None)], "origin string, status int, text string")
    icons = frame([("https://a.com/favicon.ico", 200, "image/x-icon"), ("https://www.a.com/icon.png", 200, "text/html")], "url string, status int, content_type string")
    field = frame([("https://a.com/one", "url", None, {"lcp": 2000.0, "inp": 100.0, "cls": 0.01}), ("https://a.com/four", "url", "no-data", None), ("https://a.com", "origin", None, {"lcp": 9000.0, "inp": 100.0, "cls": 0.01})], "target string, scope string, reason string, data map<string,double>")
    return audit.Fetched(pages, robots, sitemaps, llms, None, icons, field)


def test_context_of_pages(fetched):
    r = {x.page_id: x for x in audit.with_context(fetched).collect()}
    assert r[1].robots_found and r[1].sitemap_found and r[1].llms_found and r[1].blocking_rule is None and r[1].blocked_retrieval == 1 and r[1].blocked_user_triggered == 0
    assert r[7].blocking_rule == "/closed" and r[7].blocked_retrieval == 5
    assert not r[8].robots_found and not r[8].sitemap_found and not r[8].llms_found and not r[4].robots_found
    assert r[2].vitals["lcp"] == 2000 and r[5].vitals["lcp"] == 9000 and r[8].vitals is None and r[8].vitals_reason == "no-data"


def test_context_changes_findings(fetched):
    pages = audit.audited_pages(fetched).cache()
    icons = {x.page_id: x.favicon_ok for x in pages.select("page_id", "favicon_ok").collect()}
    assert icons[1] and not icons[4] and not icons[8]
    found = report.findings(pages, "seo").cache()
    status = lambda check, find=0: {r.page_id: r.status for r in found.where((F.col("check") == check) & (F.col("find_pos") == find)).collect()}
    assert status("Favicon") == {1: "ok", 2: "ok", 3: "ok", 4: "warn", 5: "ok", 6: "ok", 7: "ok", 8: "warn"}
    crawl = {r.page_id for r in found.where("check = 'Crawlability' and status = 'fail'").collect()}
    assert 7 in crawl and 6 not in crawl
    lcp = {r.page_id: r.status for r in found.where("category = 'vitals' and check like 'Core Web%' and status <> 'info'").collect()}
    assert lcp[2] == "ok" and lcp[5] != "ok" and 8 not in lcp
    geo = report.findings(pages, "geo").where("check = 'llms.txt'")
    assert {r.page_id for r in geo.where("status = 'ok'").collect()} == {1, 2, 3, 5, 6, 7}
    scores = {r.page_id: r.score for r in report.scores(found)[1].collect()}
    plain = {r.page_id: r.score for r in report.scores(report.findings(report.audited(fetched.captures)))[1].collect()}
    assert scores[2] > plain[2] and scores[7] < scores[6]


def test_site_report(spark, fetched, tmp_path):
    reports = audit.audit_sites(fetched)
    captures.write_reports(reports, str(tmp_path / "out"), one_file=True)
    rows = {r["site_key"]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect())}
    assert set(rows) == {"a.com", "b.com"}
    a, b = rows["a.com"], rows["b.com"]
    assert [(p["url"], p.get("depth"), p["source"]) for p in sorted(a["pages"], key=lambda p: (p.get("depth") is None, p.get("depth"), p["url"]))] == [
        ("https://a.com/", 0, "seed"), ("https://a.com/one", 1, "link"), ("https://a.com/two", 1, "link"), ("https://www.a.com/three", 1, "link"), ("https://a.com/four", 2, "link"), ("https://a.com/alone", None, "sitemap"),
    ]
    assert a["score"]["pages"] == 6 and b["score"]["pages"] == 1 and a["mode"] == "seo"
    i = a["issues"]
    assert [(d["label"], d["count"], d["urls"]) for d in i["duplicate_titles"]] == [("A title that is shared", 2, ["https://a.com/one", "https://a.com/two"])]
    assert [(x["url"], x["status"], x["linked_from"]) for x in i["broken"]] == [("https://a.com/two", 404, ["https://a.com/"])]
    assert [x["url"] for x in i["orphans"]] == ["https://a.com/alone"]
    assert [x["url"] for x in i["unreachable"]] == ["https://a.com/gone"]
    thin = [(x["url"], x["place"]) for x in i["lists"]["thin"]]
    assert sorted(u for u, _ in thin) == ["https://a.com/two", "https://www.a.com/three"] and [p for _, p in thin] == [1, 2]
    assert a["todos"][0]["place"] == 1 and all(t["page_count"] == len(t["pages"]) for t in a["todos"])
    assert [c["category"] for c in a["categories"]][:2] == ["meta", "quality"]
    assert audit.audit_sites(fetched, "geo", max_pages=2).where("site_key = 'a.com'").select(F.size("pages")).first()[0] == 2
