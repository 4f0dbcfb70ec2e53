"""Site reports hold whole sites."""

from pyspark.sql import functions as F

from webgauge.plans import audit
from webgauge.queries import QUERIES


def test_reports_hold_every_page_of_a_site(spark, tmp_path):
    """More pages than a crawl's budget of 25 and than the 500 addresses of a sitemap."""
    html = "<!doctype html><html lang=en><head><title>Page {0}</title></head><body><h1>Page {0}</h1><p>words</p></body></html>"
    pages = [(i, f"https://big.example/a{i}", html.format(i)) for i in range(520)] + [(1000 + i, f"https://b.example/a{i}", html.format(i)) for i in range(3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.site_key: r.pages for r in QUERIES["site_reports"](spark, str(tmp_path)).collect()}
    assert got == {"big.example": 520, "b.example": 3}


def test_reports_follow_links_to_any_depth_and_list_every_source(spark):
    """A chain of 9 pages, then 30 of one page, and a broken page that all of them link to; no sitemap."""
    html = lambda *to: "<!doctype html><html><body><p>words</p>" + "".join(f"<a href='{u}'>to {u}</a>" for u in (*to, "/lost")) + "</body></html>"
    pages = [(0, "https://a.com/", 200, html("/c1"))] + [(k, f"https://a.com/c{k}", 200, html(f"/c{k + 1}") if k < 9 else html(*(f"/d{n}" for n in range(30)))) for k in range(1, 10)]
    pages += [(100 + n, f"https://a.com/d{n}", 200, html()) for n in range(30)] + [(200, "https://a.com/lost", 404, html())]
    none = spark.createDataFrame
    captures = none(pages, "page_id long, url string, status int, html string").withColumn("as_of", F.lit("2024-06-01").cast("timestamp"))
    fetched = audit.Fetched(captures, none([("https://a.com", 404, None)], "origin string, status int, text string"), none([], "url string, status int, xml string"), none([("https://a.com", 404, None)], "origin string, status int, text string"))
    r = audit.audit_sites(fetched).first()
    assert {p.url: p.depth for p in r.pages} == {"https://a.com/": 0, "https://a.com/lost": 1} | {f"https://a.com/c{k}": k for k in range(1, 10)} | {f"https://a.com/d{n}": 10 for n in range(30)}
    assert [(b.url, len(b.linked_from)) for b in r.issues.broken] == [("https://a.com/lost", 41)]  # its own link too
    assert (r.crawl.requested, r.crawl.max_depth, r.crawl.crawled, r.crawl.discovered, r.crawl.not_visited) == (None, None, 41, 41, 0)
